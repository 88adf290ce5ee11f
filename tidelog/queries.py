"""Registered queries of the event-log library and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.rules import after_types, checkpoint_outcome, every_n, open_outcome, row_bytes, snapshot_status
from tidelog.operators import append, decide, fold, restore, scan
from tidelog.operators.upcast import Step, Upcaster
from tidelog.plans import replay
from tidelog.sources.tables import conversations_log, events_by_position, events_log, lines_log, orders_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


LOG = """log as (
  select cast(event_id + 1 as bigint) as position, user_id as stream_id,
         cast(row_number() over (partition by user_id order by event_id) as bigint) as version,
         event_type, cast(round(value * 100) as bigint) as cents, props as payload
  from events)"""
ORDERS = """log as (
  select o_custkey as stream_id, o_orderkey as order_id,
         cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as version,
         o_orderstatus as event_type, cast(round(o_totalprice * 100) as bigint) as cents
  from orders)"""
LINES = """log as (
  select l_orderkey as stream_id, cast(l_linenumber as bigint) as version,
         cast(round(l_quantity * 100) as bigint) as cents, l_returnflag as event_type
  from lineitem)"""
DELTA = "case when event_type = 'purchase' then -cents when event_type = 'signup' then cents else 0 end"
SIZE = "cast(32 + octet_length(encode(event_type)) + octet_length(encode(payload)) as bigint)"


def _delta():
    return F.when(F.col("event_type") == "purchase", -F.col("cents")).when(F.col("event_type") == "signup", F.col("cents")).otherwise(0)


# -- scans -------------------------------------------------------------------------------------------


@query(f"with {LOG} select * from log where stream_id = 7 and version >= 3")
def stream_scan_inclusive(spark, sf_dir):
    return scan.read_stream(events_log(spark, sf_dir), 7, 3)


@query(f"with {LOG} select position, stream_id, event_type, cents, payload from log where position > 500")
def all_scan_exclusive(spark, sf_dir):
    return scan.read_all(events_by_position(spark, sf_dir), 500)


@query(f"""with {LOG} select position // 100 as txid, position % 100 as seq, stream_id, event_type from log
where position // 100 > 7 or (position // 100 = 7 and position % 100 > 42)""")
def all_scan_composite(spark, sf_dir):
    log = events_by_position(spark, sf_dir).select(F.expr("position div 100").alias("txid"), (F.col("position") % 100).alias("seq"), "stream_id", "event_type")
    return scan.read_all_composite(log, (7, 42))


@query(f"with {LOG} select stream_id, max(version) as head from log group by 1")
def stream_heads(spark, sf_dir):
    """Versions are gapless, so the head of a stream is the number of its events."""
    return events_by_position(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("head"))


@query("select distinct user_id as stream_id from events")
def list_streams(spark, sf_dir):
    return scan.list_streams(events_by_position(spark, sf_dir))


@query("select distinct user_id as stream_id from events where user_id > 5 order by 1 limit 25")
def list_streams_paged(spark, sf_dir):
    return scan.list_streams(events_by_position(spark, sf_dir), 5, 25)


@query("""with c as (select c_name as stream_id, cast(32 + octet_length(encode(c_name)) as bigint) as row_bytes from customer where c_name > 'Customer#000000010' order by 1 limit 200),
r as (select *, row_number() over (order by stream_id) as ordinal, sum(row_bytes) over (order by stream_id rows unbounded preceding) as total from c)
select stream_id, row_bytes, cast(ordinal as bigint) as ordinal, cast(total as bigint) as total from r where total <= 2048 or ordinal = 1""")
def list_streams_bounded(spark, sf_dir):
    """A page of stream keys within a number of rows and of bytes."""
    return scan.list_page(table(spark, sf_dir, "customer").select(F.col("c_name").alias("stream_id")), "Customer#000000010", 200, 2048)


@query("select c_custkey as stream_id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def list_streams_semi(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"))
    visible = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("stream_id"))
    return scan.list_known_streams(keys, visible)


@query(f"""with {LOG}, h as (select stream_id, max(version) as head from log where position <= 700 group by 1)
select log.* from log join h using (stream_id) where version <= head""")
def frozen_head_scan(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return scan.frozen_scan(log, scan.stream_heads(log.where("position <= 700")))


@query(f"""with {LOG}, c as (select *, {SIZE} as row_bytes from log where position > 100 order by position limit 200),
r as (select position, stream_id, row_bytes, row_number() over (order by position) as ordinal, sum(row_bytes) over (order by position rows unbounded preceding) as total from c)
select position, stream_id, row_bytes, cast(ordinal as bigint) as ordinal, cast(total as bigint) as total from r where total <= 4096 or ordinal = 1""")
def byte_bounded_page(spark, sf_dir):
    page = scan.byte_page(events_by_position(spark, sf_dir), 100, 200, 4096, row_bytes(F.col("event_type"), F.col("payload")))
    return page.select("position", "stream_id", "row_bytes", "ordinal", "total")


@query(f"""with {LOG}, c as (select *, {SIZE} as row_bytes from log where position > 100 order by position limit 200),
r as (select position, stream_id, row_bytes, row_number() over (order by position) as ordinal, sum(row_bytes) over (order by position rows unbounded preceding) as total from c)
select position, stream_id, row_bytes, cast(ordinal as bigint) as ordinal, cast(total as bigint) as total from r where total - row_bytes < 4096""")
def batch_crossing_page(spark, sf_dir):
    page = scan.crossing_page(events_by_position(spark, sf_dir), 100, 200, 4096, row_bytes(F.col("event_type"), F.col("payload")))
    return page.select("position", "stream_id", "row_bytes", "ordinal", "total")


@query(f"with {LOG} select * from log where stream_id = 3 and version > 5")
def keyset_resume(spark, sf_dir):
    return scan.resume_stream(events_log(spark, sf_dir), 3, 5)


@query("""select count(distinct conv_id) as sections, count(*) as events, cast(sum(octet_length(encode(text))) as bigint) as bytes from conversations""")
def export_manifest_counts(spark, sf_dir):
    return restore.export_manifest(conversations_log(spark, sf_dir))


# -- folds -------------------------------------------------------------------------------------------


@query("""select user_id as stream_id, cast(sum(case event_type when 'login' then 1 when 'logout' then -1 when 'click' then 1 when 'purchase' then -1 else 0 end) as bigint) as value
from events group by 1""")
def fold_counter(spark, sf_dir):
    log = events_by_position(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type").isin("login", "click"), "up").when(F.col("event_type").isin("logout", "purchase"), "down"))
    return fold.counter(log, "up", "down")


STICKY = f"""with {LOG}, d as (select *, {DELTA} as delta from log),
r as (select *, sum(delta) over (partition by stream_id order by version rows between unbounded preceding and current row) as run from d),
s as (select stream_id, max(version) as head, cast(min(case when run < 0 then version end) as bigint) as poisoned_at, cast(sum(delta) as bigint) as net from r group by 1)
select stream_id, head, poisoned_at, case when poisoned_at is null then net end as balance from s"""


@query(STICKY)
def fold_balance_sticky(spark, sf_dir):
    return fold.sticky_balance(events_log(spark, sf_dir), _delta())


@query(f"select *, null::varchar as error from ({STICKY})")
def fold_balance_ordered(spark, sf_dir):
    """The same account folded event by event, as for a fold that nothing else expresses."""
    log = events_log(spark, sf_dir).withColumn("delta", _delta().cast("long"))
    initial = F.struct(F.lit(0).cast("long").alias("balance"), F.lit(None).cast("long").alias("poisoned_at"))

    def apply(state, event):
        total = state["balance"] + event["delta"]
        live = state["poisoned_at"].isNull()
        return F.struct(
            F.when(live, total).otherwise(state["balance"]).alias("balance"),
            F.coalesce(state["poisoned_at"], F.when(total < 0, event["version"])).alias("poisoned_at"),
        )

    folded = fold.ordered_fold(log, ["delta"], initial, apply)
    return folded.select("stream_id", "head", "state.poisoned_at", F.when(F.col("state.poisoned_at").isNull(), F.col("state.balance")).alias("balance"), "error")


@query(f"with {LOG} select stream_id, max(version) as head, arg_max(payload, version) as latest from log group by 1")
def fold_last_value(spark, sf_dir):
    return fold.latest(events_log(spark, sf_dir), "payload")


@query("""select user_id as stream_id, count(*) filter (event_type = 'click') as n_click, count(*) filter (event_type = 'purchase') as n_purchase,
count(*) filter (event_type = 'signup') as n_signup from events group by 1""")
def fold_by_type(spark, sf_dir):
    return fold.by_type(events_by_position(spark, sf_dir), ["click", "purchase", "signup"])


@query(f"""with {LINES}, n as (select *, cast(row_number() over (partition by stream_id order by version) as bigint) as n from log),
b as (select stream_id, min(n) as bad, count(*) as c from n where version <> n group by 1)
select a.stream_id, coalesce(b.bad - 1, a.c) as replayed, (select version from n where n.stream_id = a.stream_id and n.n = b.bad) as failed_at,
case when b.bad is not null then 'VersionMismatch' end as error
from (select stream_id, count(*) as c from n group by 1) a left join b using (stream_id)""")
def fold_replay_gap_check(spark, sf_dir):
    return fold.replay_check(lines_log(spark, sf_dir))


@query("""select user_id as stream_id, least(count(*), 50) as replayed, case when count(*) > 50 then cast(51 as bigint) end as failed_at,
case when count(*) > 50 then 'RehydrationLimitExceeded' end as error from events group by 1""")
def fold_replay_budget(spark, sf_dir):
    return fold.replay_check(events_log(spark, sf_dir), budget=50)


DECODED = f"""{LOG}, d as (select position, stream_id, version, case when position % 97 = 0 then null else cast(json_extract(payload, '$.k') as bigint) end as k from log)"""


def _decoded(spark, sf_dir):
    """The log's JSON payloads; every 97th is damaged."""
    log = events_log(spark, sf_dir).withColumn("payload", F.when(F.col("position") % 97 == 0, F.lit('{"broken":}')).otherwise(F.col("payload")))
    return scan.decoded(log, "k bigint")


@query(f"with {DECODED} select position, stream_id, version, k, case when k is null then 'Decode' end as error from d")
def decoded_scan(spark, sf_dir):
    return _decoded(spark, sf_dir).select("position", "stream_id", "version", F.col("event.k").alias("k"), "error")


@query(f"""with {DECODED}, f as (select stream_id, min(version) as failed_at from d where k is null group by 1)
select stream_id, count(*) filter (failed_at is null or version < failed_at) as applied, cast(coalesce(sum(k) filter (failed_at is null or version < failed_at), 0) as bigint) as total,
min(failed_at) as failed_at from d left join f using (stream_id) group by 1""")
def decoded_fold_first_error(spark, sf_dir):
    return fold.decoded_fold(_decoded(spark, sf_dir), F.col("event.k"))


# -- snapshots, triggers, checkpoints, projections ---------------------------------------------------


def _snapshots(spark, sf_dir):
    """Every third stream has a snapshot at version 10; every fifth of those is of an older schema."""
    log = events_log(spark, sf_dir).where("version <= 10 and stream_id % 3 = 0")
    taken = log.groupBy("stream_id").agg(F.max("version").alias("version"), F.sum("cents").alias("state"))
    return taken.withColumn("schema_version", F.when(F.col("stream_id") % 5 == 0, 1).otherwise(2))


@query(f"""with {LOG}, s as (select stream_id, max(version) as v from log where version <= 10 and stream_id % 3 = 0 and stream_id % 5 <> 0 group by 1)
select stream_id, max(version) as head, cast(sum(cents) as bigint) as total, cast(count(*) filter (version > coalesce(v, 0)) as bigint) as replayed
from log left join s using (stream_id) group by 1""")
def snapshot_partial_replay(spark, sf_dir):
    return replay.resumed_sum(events_log(spark, sf_dir), _snapshots(spark, sf_dir), 2, F.col("cents"))


@query("""select distinct user_id as stream_id, case when user_id % 3 <> 0 then 'Absent' when user_id % 5 = 0 then 'Stale' else 'Found' end as status from events""")
def snapshot_status_by_stream(spark, sf_dir):
    ids = scan.list_streams(events_by_position(spark, sf_dir))
    rows = ids.join(_snapshots(spark, sf_dir), "stream_id", "left")
    return rows.select("stream_id", snapshot_status(F.col("version"), F.col("schema_version"), F.lit(2)).alias("status"))


@query(f"""with {LOG}, b as (select *, lag(version) over (partition by stream_id order by version) as old from log)
select stream_id, version from b where version // 10 > coalesce(old, 0) // 10""")
def trigger_every_n(spark, sf_dir):
    return replay.trigger_points(events_log(spark, sf_dir), 10).select("stream_id", "version")


@query("select cast(event_id + 1 as bigint) as position, user_id as stream_id from events where event_type in ('purchase', 'signup')")
def trigger_after_types(spark, sf_dir):
    return events_by_position(spark, sf_dir).where(after_types(F.col("event_type"), ["purchase", "signup"])).select("position", "stream_id")


@query("select user_id as stream_id, cast(max(event_id + 1) as bigint) as position, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1")
def projection_all_position(spark, sf_dir):
    """A read model over all streams, with the position it has reached for each."""
    log = events_by_position(spark, sf_dir)
    return log.groupBy("stream_id").agg(F.max("position").alias("position"), F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("""with d as (select l_suppkey as consumer, l_orderkey * 10 + l_linenumber as delivery, min(l_partkey) as position from lineitem group by 1, 2),
s as (select *, max(position) over (partition by consumer order by delivery rows between unbounded preceding and 1 preceding) as seen from d)
select consumer, delivery, position, case when position <= seen then 'NonIncreasingPosition' else 'Applied' end as status from s""")
def projection_order_guard(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    delivery = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("delivery")
    deliveries = lines.groupBy(F.col("l_suppkey").alias("consumer"), delivery).agg(F.min("l_partkey").alias("position"))
    return replay.guard_positions(deliveries)


@query(f"""with {LOG}, d as (select *, {DELTA} as delta from log),
r as (select *, sum(delta) over (partition by stream_id order by version) as run from d),
f as (select stream_id, min(version) as failed_at from r where run < -20000 or run > 60000 group by 1)
select r.stream_id, count(*) filter (f.failed_at is null or version < f.failed_at) as applied, max(f.failed_at) as failed_at,
cast(coalesce(arg_max(run, version) filter (f.failed_at is null or version < f.failed_at), 0) as bigint) as state
from r left join f using (stream_id) group by 1""")
def projection_first_error(spark, sf_dir):
    return replay.projected(events_log(spark, sf_dir), _delta(), -20000, 60000)


CHECKPOINT_CASES = """c as (select o_orderkey as id, case when o_orderkey % 4 = 0 then null else o_orderkey % 5 end as revision,
  o_orderkey % 2 + 1 as stored_schema, o_custkey % 2 + 1 as schema, o_custkey % 50 as stored_position, o_orderkey % 60 as position,
  case when o_orderkey % 12 = 0 then null when o_orderkey % 4 = 0 then 3 else (o_orderkey + o_custkey % 2) % 5 end as expected, o_custkey % 3 = 0 as rebuild from orders)"""


@query(f"""with {CHECKPOINT_CASES} select id, case when expected is distinct from revision then 'Conflict'
when not rebuild and revision is not null and stored_schema <> schema then 'SchemaMismatch'
when not rebuild and revision is not null and position <= stored_position then 'NonIncreasingPosition'
when rebuild and (revision is null or stored_schema = schema) then 'InvalidRebuild'
when revision >= 4 then 'RevisionOverflow' else 'Committed' end as outcome from c""")
def checkpoint_cas_outcome(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    revision = F.when(k % 4 != 0, k % 5)
    expected = F.when(k % 12 == 0, None).when(k % 4 == 0, 3).otherwise((k + c % 2) % 5)
    outcome = checkpoint_outcome(expected, revision, k % 2 + 1, c % 2 + 1, c % 50, k % 60, c % 3 == 0, most=4)
    return table(spark, sf_dir, "orders").select(k.alias("id"), outcome.alias("outcome"))


@query(f"""with {CHECKPOINT_CASES} select id, case when revision is null then case when rebuild then 'InvalidRebuild' else 'Initial' end
when stored_schema = schema then case when rebuild then 'InvalidRebuild' else 'Stored' end
when rebuild then 'Rebuild' else 'SchemaMismatch' end as outcome from c""")
def projection_open_outcome(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    outcome = open_outcome(F.when(k % 4 != 0, k % 5), k % 2 + 1, c % 2 + 1, c % 3 == 0)
    return table(spark, sf_dir, "orders").select(k.alias("id"), outcome.alias("outcome"))


# -- appends and imports -----------------------------------------------------------------------------


@query(f"""with {LINES}, n as (select *, cast(row_number() over (partition by stream_id order by version, cents, event_type) as bigint) as n from log),
b as (select stream_id, count(*) as events, min(case when version <> n then n end) as bad from n group by 1)
select stream_id, events, (select version from n where n.stream_id = b.stream_id and n.n = b.bad) as first_bad, case when bad is not null then 'Conflict' end as error from b""")
def append_validate_sequence(spark, sf_dir):
    log = lines_log(spark, sf_dir).withColumn("ordinal", F.struct("version", "cents", "event_type"))
    return append.validate_sequence(log)


@query(f"""with {LOG}, heads as (select stream_id, max(version) as head from log where position <= 600 group by 1),
b as (select stream_id, version, row_number() over (partition by stream_id order by version) as n from log where position > 600),
e as (select b.*, head, case when stream_id % 7 = 0 then coalesce(head, 0) + 1 else head end as expected from b left join heads using (stream_id)),
o as (select *, case when expected is distinct from head then 'Conflict' when version <> coalesce(head, 0) + n + case when stream_id % 11 = 0 then 1 else 0 end then 'Conflict' else 'Accepted' end as outcome from e)
select stream_id, case when count(*) filter (outcome <> 'Accepted') > 0 then 'Conflict' else 'Accepted' end as outcome from o group by 1""")
def append_validate_heads(spark, sf_dir):
    log = events_log(spark, sf_dir)
    heads = scan.stream_heads(log.where("position <= 600"))
    batch = log.where("position > 600").join(heads, "stream_id", "left")
    expected = F.when(F.col("stream_id") % 7 == 0, F.coalesce("head", F.lit(0)) + 1).otherwise(F.col("head"))
    shifted = F.col("version") - F.when(F.col("stream_id") % 11 == 0, 1).otherwise(0)
    batch = batch.select("stream_id", expected.alias("expected"), shifted.alias("version"), F.col("version").alias("ordinal"))
    return append.validate_appends(batch, heads)


@query("select o_orderkey as order_id, cast(1000 + row_number() over (order by o_orderdate, o_orderkey) as bigint) as position from orders")
def append_positions(spark, sf_dir):
    batch = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderdate")
    return append.assign_positions(batch, 1000, ["o_orderdate", "order_id"]).select("order_id", "position")


@query(f"""with {LINES}, n as (select *, cast(case when stream_id % 4 = 0 then stream_id % 3 else 0 end + row_number() over (partition by stream_id order by version, cents, event_type) as bigint) as due,
 row_number() over (partition by stream_id order by version, cents, event_type) as place from log),
b as (select stream_id as index, 'NonSequential' as outcome, due, version as actual from n where version <> due order by stream_id, place limit 1)
select b.index is null as valid, b.* from (select 1) left join b on true""")
def atomic_validate_runs(spark, sf_dir):
    """Every order's lines as one run of an atomic append, some declared behind a version; the first offence."""
    expected = F.when((F.col("stream_id") % 4 == 0) & (F.col("stream_id") % 3 > 0), F.col("stream_id") % 3)
    runs = lines_log(spark, sf_dir).select(F.col("stream_id").alias("run"), expected.alias("expected"), "version", F.struct("version", "cents", "event_type").alias("ordinal"))
    return append.validate_runs(runs)


@query("""with r as (select o_orderkey as run, o_custkey as target from orders),
f as (select target, min(run) as first_index from r group by 1)
select first_index, run as duplicate_index from r join f using (target) where run > first_index order by run limit 1""")
def atomic_duplicate_targets(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("target"))
    return append.duplicate_targets(runs)


def _blocks(spark, sf_dir):
    """Exported sections from the order lines, whose versions repeat; some blocks are corrupt."""
    order = Window.partitionBy("stream_id").orderBy("version", "cents", "event_type")
    rows = lines_log(spark, sf_dir).withColumn("block", F.row_number().over(order).cast("long"))
    corrupt = (F.col("stream_id") * 7 + F.col("block")) % 19 == 0
    return rows.select(F.col("stream_id").alias("section"), "block", "version", corrupt.alias("corrupt"))


PLAN = f"""{LINES}, b as (select stream_id as section, cast(row_number() over (partition by stream_id order by version, cents, event_type) as bigint) as block, version from log),
c as (select *, (section * 7 + block) % 19 = 0 as corrupt, first_value(version) over (partition by section order by block) as v1 from b),
s as (select *, case when corrupt then 'Corrupt' when version <> v1 + block - 1 then 'Gap' end as stop from c),
a as (select section, count(*) as n, min(v1) as w1, min(case when stop is not null then block end) as at_block from s group by 1),
plan as (select a.section, case when coalesce(at_block - 1, n) > 0 then w1 end as first, case when coalesce(at_block - 1, n) > 0 then w1 + coalesce(at_block - 1, n) - 1 end as reached,
  cast(coalesce(at_block - 1, n) as bigint) as events, coalesce(s.stop, 'Complete') as halt, case when s.stop = 'Gap' then s.version end as got
  from a left join s on s.section = a.section and s.block = a.at_block)"""
HEADS = "heads as (select o_orderkey as section, cast(1 as bigint) as head from orders where o_orderkey % 6 = 1)"


def _import_heads(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 6 = 1").select(F.col("o_orderkey").alias("stream_id"), F.lit(1).cast("long").alias("head"))


@query(f"with {PLAN} select * from plan")
def import_section_plan(spark, sf_dir):
    return restore.section_plan(_blocks(spark, sf_dir))


@query(f"""with {PLAN}, {HEADS}, r as (select plan.*, head, events > 0 and coalesce(head, 0) <> first - 1 as refused from plan left join heads using (section))
select section, case when refused or halt = 'Gap' then 'Mismatch' else halt end as outcome, case when not refused then reached end as reached,
case when refused then first else got end as got from r""")
def import_per_stream_report(spark, sf_dir):
    return restore.import_report(restore.section_plan(_blocks(spark, sf_dir)), _import_heads(spark, sf_dir))


@query(f"""with {PLAN}, {HEADS}, r as (select plan.*, head, events > 0 and coalesce(head, 0) <> first - 1 as refused from plan left join heads using (section)),
bad as (select section as offender, case when halt = 'Corrupt' then 'Corrupt' else 'Mismatch' end as outcome,
 cast(case when halt = 'Gap' then reached + 1 when halt <> 'Corrupt' then coalesce(head, 0) + 1 end as bigint) as expected, case when halt = 'Gap' then got when halt <> 'Corrupt' then first end as got
 from r where halt <> 'Complete' or refused order by section limit 1)
select bad.offender is null as committed, bad.* from (select 1) left join bad on true""")
def import_whole_chunk_first_offender(spark, sf_dir):
    return restore.import_whole(restore.section_plan(_blocks(spark, sf_dir)), _import_heads(spark, sf_dir))


@query(f"""with {PLAN}, {HEADS}, r as (select plan.*, head, events > 0 and coalesce(head, 0) <> first - 1 as refused from plan left join heads using (section)),
o as (select section, case when refused or halt = 'Gap' then 'Mismatch' else halt end as outcome, case when not refused then reached end as reached, case when refused then first else got end as got from r)
select * from o where outcome <> 'Complete'""")
def import_unfinished(spark, sf_dir):
    return restore.unfinished(restore.import_report(restore.section_plan(_blocks(spark, sf_dir)), _import_heads(spark, sf_dir)))


@query(f"""with {PLAN}, {HEADS}, r as (select events > 0 and coalesce(head, 0) <> first - 1 as refused, halt from plan left join heads using (section))
select count(*) as sections, count(*) filter (refused or halt <> 'Complete') as unfinished, count(*) filter (refused or halt <> 'Complete') = 0 as all_complete from r""")
def import_all_complete(spark, sf_dir):
    return restore.all_complete(restore.import_report(restore.section_plan(_blocks(spark, sf_dir)), _import_heads(spark, sf_dir)))


# -- commands and reactions --------------------------------------------------------------------------


def _decided(spark, sf_dir):
    """Every order is a command to its customer's account: pay from the balance, or refuse."""
    states = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"))
    commands = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("command_id"), F.round(F.col("o_totalprice")).cast("long").alias("amount"), F.col("o_orderstatus").alias("status")
    )
    events = F.when(F.col("status") == "O", F.array(F.concat(F.lit("Reserved:"), F.col("amount")))).when(
        F.col("status") == "F", F.array(F.concat(F.lit("Reserved:"), F.col("amount")), F.lit("Settled"))
    )
    return decide.decide(commands, states, events, F.when(F.col("balance") < F.col("amount"), "InsufficientFunds"))


DECIDED = """d as (select o_custkey as stream_id, o_orderkey as command_id, cast(round(o_totalprice) as bigint) as amount, o_orderstatus as status,
cast(round(c_acctbal * 100) as bigint) as balance from orders left join customer on c_custkey = o_custkey),
o as (select *, case when balance < amount then 'Rejected' when status in ('O', 'F') then 'Executed' else 'Ignored' end as outcome from d)"""


@query(f"""with {DECIDED} select stream_id, command_id, outcome, case when outcome = 'Rejected' then 'InsufficientFunds' end as error,
case when outcome <> 'Executed' then 0 when status = 'O' then 1 else 2 end as n_events from o""")
def decide_command(spark, sf_dir):
    return _decided(spark, sf_dir).select("stream_id", "command_id", "outcome", "error", F.greatest(F.coalesce(F.size("events"), F.lit(0)), F.lit(0)).alias("n_events"))


@query(f"with {DECIDED} select outcome, count(*) as n from o group by 1")
def decide_noop(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""with {DECIDED} select stream_id, command_id, cast(4 as bigint) as version, 'Reserved:' || amount as event from o where outcome = 'Executed'
union all select stream_id, command_id, cast(5 as bigint), 'Settled' from o where outcome = 'Executed' and status = 'F'""")
def decide_event_versions(spark, sf_dir):
    rows = _decided(spark, sf_dir).withColumn("target", F.struct("stream_id", "command_id"))
    return decide.produced(rows, F.lit(3), "target").select("target.stream_id", "target.command_id", "version", "event")


SAGA = """u as (select cast(event_id + 1 as bigint) as position, user_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events)"""


def _routed(spark, sf_dir):
    log = events_by_position(spark, sf_dir).withColumn("k", F.get_json_object("payload", "$.k").cast("long"))
    return decide.correlate(log, F.when(F.col("event_type").isin("signup", "purchase"), F.col("k")))


@query(f"with {SAGA} select k as saga_id, position, event_type from u where event_type in ('signup', 'purchase') and k is not null")
def saga_correlate(spark, sf_dir):
    return _routed(spark, sf_dir).select("saga_id", "position", "event_type")


@query(f"""with {SAGA}, r as (select k as saga_id, position, event_type, row_number() over (partition by k order by position) as n,
sum(case when event_type = 'signup' then 1 else 0 end) over (partition by k order by position) as placed from u where event_type in ('signup', 'purchase') and k is not null)
select saga_id, position, case when event_type = 'signup' then 'PaymentRequested' when placed > 0 then 'OrderCompleted' end as reaction from r""")
def saga_react(spark, sf_dir):
    events = _routed(spark, sf_dir).select(F.col("saga_id").alias("stream_id"), F.col("position").alias("version"), "event_type")
    rows = fold.running_sum(events, F.when(F.col("event_type") == "signup", 1).otherwise(0), "placed")
    reaction = F.when(F.col("event_type") == "signup", "PaymentRequested").when(F.col("placed") > 0, "OrderCompleted")
    return rows.select(F.col("stream_id").alias("saga_id"), F.col("version").alias("position"), reaction.alias("reaction"))


@query(f"""with {SAGA}, r as (select k as saga_id, position, event_type from u where event_type in ('signup', 'purchase') and k is not null),
p as (select *, min(case when event_type = 'signup' then position end) over (partition by saga_id) as placed from r),
s as (select *, min(case when event_type = 'purchase' and position > placed then position end) over (partition by saga_id) as settled from p),
o as (select *, case when event_type = 'signup' then case when position = placed then 'Reacted' else 'Ignored' end
  when placed is null or position < placed then 'Rejected' when position = settled then 'Reacted' else 'Ignored' end as outcome from s)
select saga_id, position, outcome, case when outcome = 'Rejected' then 'UnknownOrder' end as error,
case when outcome = 'Reacted' then case when event_type = 'signup' then 'PaymentRequested' else 'PaymentSettled,OrderCompleted' end else '' end as events from o""")
def saga_react_and_save(spark, sf_dir):
    """Orders as sagas with a state: a payment before its order is refused, repeats are ignored, a settlement gives two events."""
    signup = lambda e: e["event_type"] == "signup"

    def reaction(state, event):
        error = F.when(~signup(event) & ~state["placed"], "UnknownOrder")
        placing = F.when(~state["placed"], F.array(F.lit("PaymentRequested")))
        settling = F.when(~state["completed"], F.array(F.lit("PaymentSettled"), F.lit("OrderCompleted")))
        return error, F.when(signup(event), placing).otherwise(settling)

    def advance(state, event, events):
        return F.struct(F.lit(True).alias("placed"), (state["completed"] | ~signup(event)).alias("completed"))

    start = F.struct(F.lit(False).alias("placed"), F.lit(False).alias("completed"))
    found = decide.react(_routed(spark, sf_dir), ["event_type"], start, reaction, advance)
    return found.withColumn("events", F.coalesce(F.array_join("events", ","), F.lit("")))


@query(f"""with {SAGA}, r as (select k as saga_id, event_type, cast(row_number() over (partition by k order by position) as bigint) as version from u where event_type in ('signup', 'purchase') and k is not null)
select saga_id, version, 'TakePayment' as intent from r where event_type = 'signup'""")
def saga_intents(spark, sf_dir):
    rows = fold.numbered(_routed(spark, sf_dir), "saga_id", ["position"], F.floor(F.col("position") / fold.BLOCK))
    return decide.intents(rows, F.when(F.col("event_type") == "signup", "TakePayment")).select("saga_id", "version", "intent")


@query("select l_orderkey as saga_id, cast(l_linenumber as bigint) as version from lineitem group by 1, 2")
def saga_dedup(spark, sf_dir):
    messages = lines_log(spark, sf_dir).select(F.col("stream_id").alias("saga_id"), "version")
    return decide.deduplicated(messages, ["saga_id", "version"])


@query(f"""with {ORDERS}, a as (select stream_id, order_id as request_id, version - 1 as expected, event_type as command, version from log where version <= 4),
h as (select stream_id, max(version) as head from a group by 1),
q as (select stream_id, order_id as request_id, case when version = 1 then null when order_id % 9 = 0 then version else version - 1 end as expected,
 case when order_id % 4 = 0 then 'X' else event_type end as command from log where version <= 6),
j as (select q.*, a.version as receipt_version, a.command as ac, nullif(a.expected, 0) as ae, head from q left join a using (stream_id, request_id) left join h using (stream_id))
select stream_id, request_id, receipt_version, case when receipt_version is not null and (ac is distinct from command or ae is distinct from expected) then 'Mismatch'
 when receipt_version is not null then 'Receipt' when expected is distinct from head then 'Conflict' else 'Execute' end as outcome from j""")
def command_idempotency(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    before = F.when(F.col("version") > 1, F.col("version") - 1)
    accepted = log.where("version <= 4").select("stream_id", F.col("order_id").alias("request_id"), before.alias("expected"), F.col("event_type").alias("command"), "version")
    heads = scan.stream_heads(accepted)
    asked = log.where("version <= 6").select(
        "stream_id", F.col("order_id").alias("request_id"),
        F.when((F.col("version") > 1) & (F.col("order_id") % 9 == 0), F.col("version")).otherwise(before).alias("expected"),
        F.when(F.col("order_id") % 4 == 0, "X").otherwise(F.col("event_type")).alias("command"),
    )
    return decide.submit(asked, accepted, heads).select("stream_id", "request_id", "receipt_version", "outcome")


@query("""select o_orderkey as record, l_linenumber as fact, cast(round(l_quantity * 100) as bigint) as cents from orders left join lineitem on l_orderkey = o_orderkey""")
def acceptance_explode(spark, sf_dir):
    """Records that hold their facts in one row, taken apart; a record without facts keeps one row."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("fact"), F.round(F.col("l_quantity") * 100).cast("long").alias("cents"))).alias("facts")
    )
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record")).join(facts, F.col("record") == F.col("l_orderkey"), "left")
    return records.select("record", F.explode_outer("facts").alias("f")).select("record", "f.fact", "f.cents")


@query("""select l_orderkey as stream_id, cast(l_linenumber as bigint) as request_id, count(*) as n from lineitem group by 1, 2 having count(*) > 1""")
def command_corrupt_state(spark, sf_dir):
    """Streams whose acceptance records repeat a request id; their states are corrupt."""
    counts = lines_log(spark, sf_dir).groupBy("stream_id", F.col("version").alias("request_id")).agg(F.count("*").alias("n"))
    return counts.where("n > 1")


@query(f"""with {ORDERS}, f as (select l_orderkey, count(*) as n from lineitem group by 1),
r as (select log.stream_id, version, order_id % 1000 as request_id, coalesce(n, 0) as n from log left join f on l_orderkey = order_id),
s as (select *, sum(n) over (partition by stream_id order by version) as running, min(version) over (partition by stream_id, request_id) as first from r),
c as (select *, min(case when version > first or running > 60 then version end) over (partition by stream_id) as corrupt_at from s)
select stream_id, count(*) filter (corrupt_at is null or version < corrupt_at) as records,
cast(coalesce(sum(n) filter (corrupt_at is null or version < corrupt_at), 0) as bigint) as facts, min(corrupt_at) as corrupt_at from c group by 1""")
def command_fact_budget(spark, sf_dir):
    """Acceptance records of every customer, each with its order's lines as facts, until one repeats a request or passes the budget."""
    facts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("n"))
    records = orders_log(spark, sf_dir).join(facts, "order_id", "left").withColumn("request_id", F.col("order_id") % 1000)
    return decide.accepted_until(records, F.coalesce("n", F.lit(0)), 60)


# -- schema evolution --------------------------------------------------------------------------------


def _upcaster() -> Upcaster:
    return Upcaster([
        Step("click", 1, lambda p: F.concat(p, F.lit("|2"))),
        Step("click", 2, lambda p: F.concat(p, F.lit("|3"))),
        Step("signup", 1, lambda p: F.upper(p), rename="registered"),
        Step("purchase", 1, lambda p: F.regexp_replace(p, "k", "key")),
    ])


def _stored(spark, sf_dir):
    return events_by_position(spark, sf_dir).withColumn("schema_version", (F.col("position") % 4 + 1).cast("long"))


UPCAST = """s as (select cast(event_id + 1 as bigint) as position, event_type, props as payload, cast((event_id + 1) % 4 + 1 as bigint) as sv from events),
a as (select *, case when event_type = 'signup' and sv = 1 then 'registered' else event_type end as upcast_type,
 case when event_type = 'click' and sv in (1, 2) then 3 when event_type in ('signup', 'purchase') and sv = 1 then 2 else sv end as upcast_schema,
 case when event_type = 'click' and sv = 1 then payload || '|2|3' when event_type = 'click' and sv = 2 then payload || '|3'
      when event_type = 'signup' and sv = 1 then upper(payload) when event_type = 'purchase' and sv = 1 then replace(payload, 'k', 'key') else payload end as upcast_payload from s),
e as (select *, case when (event_type = 'click' and sv = 4) or (event_type = 'purchase' and sv > 2) or (event_type = 'signup' and sv > 1) then 'UnsupportedSchema' end as upcast_error from a)"""


@query(f"with {UPCAST} select position, upcast_type, cast(upcast_schema as bigint) as upcast_schema, upcast_payload from e where upcast_error is null")
def upcast_chain(spark, sf_dir):
    rows = _upcaster().apply(_stored(spark, sf_dir)).where("upcast_error is null")
    return rows.select("position", "upcast_type", "upcast_schema", "upcast_payload")


@query(f"with {UPCAST} select position, event_type, sv as schema_version, upcast_error from e where upcast_error is not null")
def upcast_unsupported_schema(spark, sf_dir):
    rows = _upcaster().apply(_stored(spark, sf_dir)).where("upcast_error is not null")
    return rows.select("position", "event_type", "schema_version", "upcast_error")


@query("select distinct event_type, cast(case event_type when 'click' then 3 when 'purchase' then 2 else 1 end as bigint) as current_schema from events")
def schema_current_version(spark, sf_dir):
    types = events_by_position(spark, sf_dir).select("event_type").distinct()
    return types.select("event_type", _upcaster().schema_column(F.col("event_type")).alias("current_schema"))


@query("""select event_type, count(*) filter (cast(json_extract(props, '$.k') as bigint) < 50) as n_absent,
count(*) filter (cast(json_extract(props, '$.k') as bigint) >= 50) as n_present from events group by 1""")
def metadata_absent_vs_present(spark, sf_dir):
    metadata = F.when(F.get_json_object("payload", "$.k").cast("long") >= 50, F.col("payload").cast("binary"))
    rows = events_by_position(spark, sf_dir).withColumn("metadata", metadata)
    return rows.groupBy("event_type").agg(F.count_if(F.col("metadata").isNull()).alias("n_absent"), F.count_if(F.col("metadata").isNotNull()).alias("n_present"))


# -- read models -------------------------------------------------------------------------------------


@query("""with t as (select o_orderkey as id, o_orderdate as created, o_orderstatus as status from orders),
l as (select o_custkey % 500 as slot, o_orderkey as id, o_orderdate as created, o_orderstatus as status from orders),
s as (select slot, min((created, id)) as born, arg_max(status, (created, id)) as status from l group by 1)
select slot, born[2] as created_by, status from s where status <> 'P' order by born limit 50 offset 100""")
def todos_index_page(spark, sf_dir):
    """A page of a list of open items in creation order; an item's last event decides whether it is listed."""
    order = F.struct("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("slot")).agg(F.min(order).alias("born"), F.max_by("o_orderstatus", order).alias("status"))
    return rows.where("status <> 'P'").orderBy("born").offset(100).limit(50).select("slot", F.col("born.o_orderkey").alias("created_by"), "status")


SHIFTS = f"""{LOG}, x as (select *, (version - 1) // 10 as shift from log),
s as (select stream_id, shift, cast(sum(case when event_type = 'purchase' then cents else 0 end) as bigint) as registered, cast(sum(case when event_type in ('purchase', 'click') then cents else 0 end) // 2 as bigint) as declared from x group by 1, 2)"""


def _shifts(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("shift", F.expr("(version - 1) div 10"))
    sums = log.groupBy("stream_id", "shift").agg(
        F.sum(F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0)).alias("registered"),
        F.sum(F.when(F.col("event_type").isin("purchase", "click"), F.col("cents")).otherwise(0)).alias("both"),
    )
    return sums.select("stream_id", "shift", "registered", F.expr("both div 2").alias("declared"))


@query(f"""with {SHIFTS} select stream_id, shift, registered, declared, greatest(declared - registered, 0) as overage, greatest(registered - declared, 0) as shortage from s""")
def closing_books_summary(spark, sf_dir):
    gap = F.col("declared") - F.col("registered")
    return _shifts(spark, sf_dir).select("stream_id", "shift", "registered", "declared", F.greatest(gap, F.lit(0)).alias("overage"), F.greatest(-gap, F.lit(0)).alias("shortage"))


@query(f"""with {SHIFTS} select stream_id, shift, coalesce(lag(declared) over (partition by stream_id order by shift), 0) as opening_float, declared as final_float from s""")
def closing_books_carry_forward(spark, sf_dir):
    before = F.lag("declared").over(Window.partitionBy("stream_id").orderBy("shift"))
    return _shifts(spark, sf_dir).select("stream_id", "shift", F.coalesce(before, F.lit(0)).alias("opening_float"), F.col("declared").alias("final_float"))


@query(f"""with {LOG}, d as (select *, sha256(stream_id || ':' || version || ':' || payload) as digest from log),
c as (select *, case when position % 97 = 0 then sha256('tampered') else lag(digest) over (partition by stream_id order by version) end as prior from d),
k as (select *, lag(digest) over (partition by stream_id order by version) as want from c)
select stream_id, count(*) as events, cast(min(case when version > 1 and prior is distinct from want then version end) as bigint) as broken_at from k group by 1""")
def hash_chain_check(spark, sf_dir):
    """Streams whose events name the digest of the event before; where the chain first breaks."""
    order = Window.partitionBy("stream_id").orderBy("version")
    digest = F.sha2(F.concat_ws(":", "stream_id", "version", "payload"), 256)
    rows = events_log(spark, sf_dir).withColumn("digest", digest).withColumn("want", F.lag("digest").over(order))
    rows = rows.withColumn("prior", F.when(F.col("position") % 97 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("want")))
    broken = (F.col("version") > 1) & ~F.col("prior").eqNullSafe(F.col("want"))
    return rows.groupBy("stream_id").agg(F.count("*").alias("events"), F.min(F.when(broken, F.col("version"))).alias("broken_at"))
