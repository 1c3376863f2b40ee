"""Events to stored tables and back."""

from pyspark.sql import functions as F

from spoor.catalog.rebuild import ATTR, CLOSED, READY
from spoor.catalog.registry import query
from spoor.catalog.sinks import scratch
from spoor.catalog.spans import BUILT, K3
from spoor.operators import ingest as op
from spoor.sources import tables
from spoor.session import cut_lineage, measured

BOUNDS = "bn AS (SELECT source_key, min(ts_ns) + 86400000000000 AS boundary_ns FROM v_events GROUP BY 1)"
ALL = f"WITH {ATTR}{READY[len(CLOSED):]}{BUILT[len(CLOSED):]}, {BOUNDS}"
UID = "md5(concat('b', right(source_key, 4), chr(0), {span}, '#', {segment}))"
# a span's row, and the parent instance entered last before it
SPANS = f"""pr AS (SELECT source_key AS psk, span_id AS pid, segment AS parent_segment, start_ns AS parent_start FROM built),
sp1 AS (SELECT b.*, p.parent_segment FROM built b LEFT JOIN LATERAL (SELECT * FROM pr WHERE pr.psk = b.source_key AND b.parent_span_id > 0 AND pr.pid = b.parent_span_id AND pr.parent_start <= b.start_ns
 ORDER BY parent_start DESC, parent_segment DESC LIMIT 1) p ON true),
sp2 AS (SELECT s.*, {UID.format(span='span_id', segment='segment')} AS span_uid, md5(concat('tracing', chr(0), chr(0), name, chr(0), chr(0))) AS span_type_uid,
 CASE WHEN parent_segment IS NOT NULL THEN {UID.format(span='parent_span_id', segment='parent_segment')} END AS parent_span_uid,
 active_ns IS NOT NULL AND unbalanced_enters = 0 AND unbalanced_exits = 0 AND start_ns >= boundary_ns AND right(source_key, 1) <> '9' AS details_complete FROM sp1 s JOIN bn USING (source_key)),
ins AS (SELECT DISTINCT a.sample_id, a.source_key, a.source, p.span_id, p.segment FROM attr a JOIN pairs p ON p.source_key = a.source_key AND p.lane = a.poll_task AND p.state = 'paired' AND p.start_ns <= a.t AND a.t < p.end_ns),
iu AS (SELECT i.*, s.span_uid FROM ins i JOIN sp2 s USING ({K3}))"""


def sources(t):
    """Files with their process; a day's lead stands for spans that began in the file before; weeks ending in 9 have a made-up identity."""
    key = F.col("source_key")
    return t.events().groupBy("source_key").agg((F.min("ts_ns") + 86_400_000_000_000).alias("boundary_ns")).select(
        "source_key", "boundary_ns", F.concat(F.lit("b"), F.right(key, F.lit(4))).alias("boot_id"),
        F.when(F.right(key, F.lit(1)) == "9", "inferred").otherwise("path").alias("identity_quality"),
        F.lit("svc").alias("service"), F.lit("all").alias("date"), F.split_part(key, F.lit("/"), F.lit(1)).alias("host"))


def stored(t, name):
    """One of the four tables made from the events, folded in two calls (half of the files each) and read back."""
    out = scratch(t)
    files = measured(sources(t))
    made = {name: cut_lineage(op.ingest(t.events(), t.span_events(), t.cpu(), files, tables=[name])[name])}  # two calls read it
    early = F.right(F.col("source_key"), F.lit(1)).isin("0", "2", "4", "6", "8")
    op.ingest_files(t.spark, out, made, files.filter(early))
    op.ingest_files(t.spark, out, made, files)  # only the rest is new
    return tables.read_table(t.spark, out, name)


@query("ingest_polls", f"""{ALL}, ct AS (SELECT source_key, poll_seq, count(*) FILTER (source = 0) AS c0, count(*) FILTER (source = 1) AS c1 FROM attr WHERE poll_seq IS NOT NULL GROUP BY 1, 2),
ti AS (SELECT source_key, task_id, arg_max(instrumented, ts_ns) AS instrumented FROM v_events WHERE kind = 'TaskSpawn' GROUP BY 1, 2)
SELECT r.source_key, r.worker_id, r.task_id, r.spawn_loc, start_ns, end_ns, end_ns - start_ns AS duration_ns, ready_at_ns, scheduling_delay_ns, scheduling_delay_kind, waker_task_id,
 instrumented AS task_instrumented, coalesce(c0, 0) AS cpu_sample_count, coalesce(c1, 0) AS sched_sample_count FROM readiness r LEFT JOIN ct ON ct.source_key = r.source_key AND ct.poll_seq = r.seq LEFT JOIN ti ON ti.source_key = r.source_key AND ti.task_id = r.task_id""")
def _(t):
    return stored(t, "polls").drop("service", "date", "host", "leaf")


@query("ingest_samples", f"""{ALL}, {SPANS}, en AS (SELECT source_key, sample_id, string_agg(span_uid, ',' ORDER BY span_uid) AS spans FROM iu GROUP BY 1, 2)
SELECT a.source_key, t AS ts_ns, md5(array_to_string(frames, chr(0))) AS stack_id, worker_id, source, poll_end - poll_start AS poll_duration_ns, poll_loc AS spawn_location, coalesce(spans, '') AS spans
FROM attr a LEFT JOIN en ON en.source_key = a.source_key AND en.sample_id = a.sample_id""")
def _(t):
    uids = F.array_join(F.transform(F.coalesce("enclosing_spans", F.array()), lambda s: s["span_uid"]), ",")
    return stored(t, "samples").select("source_key", "ts_ns", "stack_id", "worker_id", "source", "poll_duration_ns", "spawn_location", uids.alias("spans"))


@query("ingest_spans", f"""{ALL}, {SPANS}, cn AS (SELECT {K3}, count(*) FILTER (source = 0) AS c0, count(*) FILTER (source = 1) AS c1 FROM iu GROUP BY {K3})
SELECT source_key, span_uid, span_type_uid, parent_span_uid, name, start_ns, end_ns, elapsed_ns, active_ns, observed_active_wall_ns AS detail_coverage_ns, details_complete, concurrent, on_cpu_ns_est, async_wait_ns,
 unknown_ns, attribution_flags, unbalanced_enters, unbalanced_exits, CASE WHEN right(source_key, 1) = '9' THEN 'inferred' ELSE 'path' END AS identity_quality, coalesce(c0, 0) AS cpu_sample_count, coalesce(c1, 0) AS sched_sample_count FROM sp2 LEFT JOIN cn USING ({K3})""")
def _(t):
    return stored(t, "spans").select(
        "source_key", "span_uid", "span_type_uid", "parent_span_uid", "name", "start_ns", "end_ns", "elapsed_ns", "active_ns", "detail_coverage_ns", "details_complete", "concurrent",
        "on_cpu_ns_est", "async_wait_ns", "unknown_ns", "attribution_flags", "unbalanced_enters", "unbalanced_exits", "identity_quality", "cpu_sample_count", "sched_sample_count")


@query("ingest_stacks", "SELECT md5(array_to_string(frames, chr(0))) AS stack_id, array_to_string(any_value(frames), ';') AS stack FROM v_cpu GROUP BY 1")
def _(t):
    out = scratch(t)
    files = sources(t)
    op.ingest_files(t.spark, out, {"stacks": op.ingest_stacks(t.cpu())}, files)
    return tables.read_stacks(t.spark, out).select("stack_id", F.array_join("frames", ";").alias("stack"))
