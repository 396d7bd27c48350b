"""Queries of limiters, allocators, queues and dirty logs, held against recursive SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import aggregates, state
from .registry import query, table

MS = 1_000_000


def _requests(spark, sf_dir):
    ts = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", ts, F.abs(F.round("value")).cast("bigint").alias("tokens"))


_REQUESTS = "SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 AS ts_ns, CAST(abs(round(value)) AS BIGINT) AS tokens FROM events"


def _bucket_step(size: int, refill_ms: int) -> str:
    """What a bucket (burst, budget, last) makes of q.tokens at q.ts_ns: columns of a struct."""
    full = "burst > 0 AND burst >= tokens"
    need = "(tokens - greatest(burst, 0))"
    filled = f"least({size}, budget + (ts_ns - last) * {size} // {refill_ms * MS})"
    return f"""CASE WHEN {full} THEN {{'outcome': 'success', 'ratio': CAST(0 AS DOUBLE), 'budget': budget, 'burst': burst - tokens}}
WHEN {need} <= {filled} THEN {{'outcome': 'success', 'ratio': CAST(0 AS DOUBLE), 'budget': {filled} - {need}, 'burst': CAST(0 AS BIGINT)}}
WHEN {need} <= {size} THEN {{'outcome': 'failure', 'ratio': CAST(0 AS DOUBLE), 'budget': {filled}, 'burst': CAST(0 AS BIGINT)}}
ELSE {{'outcome': 'over', 'ratio': ({need} - {filled}) / CAST({size} AS DOUBLE), 'budget': CAST(0 AS BIGINT), 'burst': CAST(0 AS BIGINT)}} END"""


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS r FROM ({_REQUESTS})),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, {{'outcome': '', 'ratio': CAST(0 AS DOUBLE), 'budget': CAST(200 AS BIGINT), 'burst': CAST(100 AS BIGINT)}} AS st, ts_ns AS last FROM q WHERE r = 1
  UNION ALL SELECT user_id, r, event_id, {_bucket_step(200, 3_600_000)}, ts_ns FROM (SELECT q.*, s.st.budget AS budget, s.st.burst AS burst, s.last AS last FROM s JOIN q ON q.user_id = s.user_id AND q.r = s.r + 1))
SELECT user_id, event_id, st.outcome AS outcome, round(st.ratio, 6) AS ratio, st.budget AS budget, st.burst AS burst FROM s WHERE r > 0""")
def token_bucket(spark, sf_dir):
    out = state.token_bucket(_requests(spark, sf_dir), ["user_id"], ["ts_ns", "event_id"], "ts_ns", "tokens", 200, 100, 3_600_000)
    return out.select("user_id", "event_id", "outcome", F.round("ratio", 6).alias("ratio"), "budget", "burst")


_KINDS = "CASE event_type WHEN 'error' THEN 'ops' WHEN 'signup' THEN '+bytes' WHEN 'click' THEN 'other' ELSE 'bytes' END"


def _limits(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "ops").when(F.col("event_type") == "signup", "+bytes").when(F.col("event_type") == "click", "other").otherwise("bytes")
    # seconds of real time stand for hours
    r = _requests(spark, sf_dir).withColumn("ts_ns", F.expr("ts_ns div 36000")).withColumn("kind", kind).withColumn("grp", F.col("user_id") % 40)
    return state.limit(r, ["grp"], ["ts_ns", "event_id"], "ts_ns", "kind", "tokens", {"bytes": (200, 100, 1000), "ops": (150, 0, 60_000)})


#: One limiter's steps: buckets b (bytes) and o (ops), the time until which it's blocked. "+bytes" gives back.
_LIMIT_SQL = f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts_ns, event_id) AS r FROM (SELECT event_id, user_id % 40 AS grp, {_KINDS} AS kind, ts_ns // 36000 AS ts_ns, tokens FROM ({_REQUESTS}))),
s AS (SELECT grp, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, true AS allowed, ts_ns AS until, ts_ns AS before, {{'outcome': '', 'ratio': CAST(0 AS DOUBLE), 'budget': CAST(200 AS BIGINT), 'burst': CAST(100 AS BIGINT)}} AS b, ts_ns AS bl,
    {{'outcome': '', 'ratio': CAST(0 AS DOUBLE), 'budget': CAST(150 AS BIGINT), 'burst': CAST(0 AS BIGINT)}} AS o, ts_ns AS ol FROM q WHERE r = 1
  UNION ALL SELECT grp, r, event_id, kind IN ('+bytes') OR (ts_ns >= until AND (kind = 'other' OR CASE kind WHEN 'bytes' THEN nb.outcome ELSE no.outcome END <> 'failure')),
    CASE WHEN ts_ns < until OR kind IN ('other', '+bytes') THEN until WHEN n.outcome = 'failure' THEN ts_ns + 100000000 WHEN n.outcome = 'over' THEN ts_ns + CAST(floor(n.ratio * CASE kind WHEN 'bytes' THEN 1000 ELSE 60000 END) AS BIGINT) * 1000000 ELSE until END, until,
    CASE WHEN kind = '+bytes' THEN CASE WHEN b.burst > 0 THEN {{'outcome': '', 'ratio': CAST(0 AS DOUBLE), 'budget': b.budget, 'burst': b.burst + tokens}} ELSE {{'outcome': '', 'ratio': CAST(0 AS DOUBLE), 'budget': least(200, b.budget + tokens), 'burst': b.burst}} END
      WHEN kind = 'bytes' AND ts_ns >= until THEN nb ELSE b END, CASE WHEN kind = 'bytes' AND ts_ns >= until THEN ts_ns ELSE bl END,
    CASE WHEN kind = 'ops' AND ts_ns >= until THEN no ELSE o END, CASE WHEN kind = 'ops' AND ts_ns >= until THEN ts_ns ELSE ol END
  FROM (SELECT *, CASE kind WHEN 'bytes' THEN nb ELSE no END AS n FROM (SELECT q.*, s.until, s.b, s.bl, s.o, s.ol,
    (SELECT {_bucket_step(200, 1000)} FROM (SELECT s.b.burst AS burst, s.b.budget AS budget, s.bl AS last, q.tokens AS tokens, q.ts_ns AS ts_ns)) AS nb,
    (SELECT {_bucket_step(150, 60_000)} FROM (SELECT s.o.burst AS burst, s.o.budget AS budget, s.ol AS last, q.tokens AS tokens, q.ts_ns AS ts_ns)) AS no
    FROM s JOIN q ON q.grp = s.grp AND q.r = s.r + 1)))"""


@query(_LIMIT_SQL + " SELECT grp, event_id, allowed, CASE WHEN until <> before THEN until END AS blocked_until FROM s WHERE r > 0")
def rate_limit(spark, sf_dir):
    return _limits(spark, sf_dir).select("grp", "event_id", "allowed", "blocked_until")


@query(_LIMIT_SQL + " SELECT DISTINCT c_custkey AS handle, grp, until AS at FROM s JOIN customer ON c_custkey % 50 = grp WHERE r > 0 AND until <> before")
def group_unblocked(spark, sf_dir):
    handles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("handle"), (F.col("c_custkey") % 50).alias("grp"))
    return state.unblocked(_limits(spark, sf_dir), handles, ["grp"]).select("handle", "grp", "at")


#: Ranges are lists of starts and ends from the top; the first gap that fits is taken at its upper end, aligned to 16. Every third request asks for an address.
@query("""WITH RECURSIVE q AS (SELECT o_custkey AS k, o_orderkey AS id, 16 + o_orderkey % 100 AS len, CASE WHEN o_orderkey % 3 = 0 THEN 4096 + o_orderkey % 32 * 128 END AS at_, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS address, [CAST(8192 AS BIGINT)] AS st, [CAST(8192 AS BIGINT)] AS en FROM q
  UNION ALL SELECT k, r, id, got, CASE WHEN got IS NULL THEN st ELSE list_reverse_sort(list_append(st, got)) END, CASE WHEN got IS NULL THEN en ELSE list_reverse_sort(list_append(en, got + len)) END
  FROM (SELECT *, CASE WHEN at_ IS NULL THEN CASE WHEN g IS NOT NULL THEN (st[g] - len) // 16 * 16 END
      WHEN len(list_filter(range(1, len(st) + 1), lambda i: st[i] < at_ + len AND (en[i] > at_ OR st[i] = at_))) = 0 AND at_ + len <= 8192 THEN at_ END AS got
    FROM (SELECT q.*, s.st, s.en, list_filter(range(1, len(s.st) + 1), lambda i: s.st[i] - (coalesce(s.en[i + 1], 4096) + 15) // 16 * 16 >= q.len)[1] AS g FROM s JOIN q ON q.k = s.k AND q.r = s.r + 1)))
SELECT k, id, address FROM s WHERE r > 0""")
def address_allocation(spark, sf_dir):
    o = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), o.alias("id"), F.lit("allocate").alias("op"), F.when(o % 3 == 0, 4096 + o % 32 * 128).alias("at"), (16 + o % 100).alias("length"), F.when(o % 3 > 0, 16).cast("bigint").alias("align"))
    return state.allocate_addresses(r, ["k"], ["id"], 0x1000, 0x1000).select("k", "id", "address")


def _slots_sql(step: str, extra: str = "") -> str:
    """Slot requests of users in order: take (every event but a purchase or error) or free of event_id % 6; `step` gives got, used, list."""
    return f"""WITH RECURSIVE q AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'free' ELSE 'take' END AS op, event_id % 6 AS slot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS got, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS freed, CAST(0 AS BIGINT) AS nxt FROM q
  UNION ALL SELECT user_id, r, event_id, {step} FROM (SELECT q.*, s.used, s.freed, s.nxt, {extra or 'NULL AS free_'} FROM s JOIN q ON q.user_id = s.user_id AND q.r = s.r + 1))
SELECT user_id, event_id, got FROM s WHERE r > 0"""


def _slots(spark, sf_dir, policy, size=1 << 30):
    r = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("purchase", "error"), "free").otherwise("take").alias("op"), (F.col("event_id") % 6).alias("n"))
    r = r.withColumn("slot", F.when(F.col("op") == "free", F.col("n")))
    return state.allocate_slots(r, ["user_id"], ["event_id"], policy, size).select("user_id", "event_id", "got")


_LOWEST = "list_filter(range(0, 8), lambda i: NOT list_contains(s.used, i))[1] AS free_"
_FREE = "CASE WHEN list_contains(used, slot) THEN slot END"
_WITHOUT = "list_filter(used, lambda x: x <> slot)"


@query(_slots_sql(f"CASE WHEN op = 'free' THEN {_FREE} ELSE free_ END, CASE WHEN op = 'free' THEN {_WITHOUT} WHEN free_ IS NULL THEN used ELSE list_append(used, free_) END, freed, nxt", _LOWEST))
def lowest_slots(spark, sf_dir):
    return _slots(spark, sf_dir, "lowest", 8)


@query(_slots_sql("CASE WHEN op = 'free' THEN slot WHEN len(freed) > 0 THEN freed[-1] ELSE nxt END, used, CASE WHEN op = 'free' THEN list_append(freed, slot) WHEN len(freed) > 0 THEN freed[:-2] ELSE freed END, CASE WHEN op = 'free' OR len(freed) > 0 THEN nxt ELSE nxt + 1 END"))
def last_freed_slots(spark, sf_dir):
    return _slots(spark, sf_dir, "lifo")


@query(_slots_sql(f"CASE WHEN op = 'free' THEN {_FREE} ELSE free_ END, CASE WHEN op = 'free' THEN {_WITHOUT} WHEN free_ IS NULL THEN used ELSE list_append(used, free_) END, freed, CASE WHEN op = 'free' OR free_ IS NULL THEN nxt ELSE (free_ + 1) % 5 END", "list_filter(list_transform(range(0, 5), lambda i: (s.nxt + i) % 5), lambda i: NOT list_contains(s.used, i))[1] AS free_"))
def port_slots(spark, sf_dir):
    return _slots(spark, sf_dir, "port", 5)


#: Slots 0 and 2 are reserved by the first two events of a user; a given slot may be one of these.
@query("""WITH RECURSIVE q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, event_type, event_id % 6 AS n FROM events),
o AS (SELECT *, CASE WHEN r <= 2 THEN 'reserve' WHEN event_type = 'error' THEN 'free' ELSE 'take' END AS op, CASE WHEN r <= 2 THEN (r - 1) * 2 WHEN event_type IN ('error', 'click') THEN n END AS slot FROM q),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS got, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS reserved FROM q
  UNION ALL SELECT user_id, r, event_id, got, CASE WHEN op = 'free' THEN list_filter(used, lambda x: x IS DISTINCT FROM got) WHEN op = 'take' AND got IS NOT NULL THEN list_append(used, got) ELSE used END,
    CASE WHEN op = 'reserve' THEN list_append(reserved, slot) WHEN op = 'take' THEN list_filter(reserved, lambda x: x IS DISTINCT FROM got) ELSE reserved END
  FROM (SELECT *, CASE WHEN op = 'reserve' THEN slot WHEN op = 'free' THEN CASE WHEN list_contains(used, slot) THEN slot END WHEN slot IS NOT NULL THEN CASE WHEN NOT list_contains(used, slot) THEN slot END
      ELSE list_filter(range(0, 8), lambda i: NOT list_contains(used, i) AND NOT list_contains(reserved, i))[1] END AS got
    FROM (SELECT o.*, s.used, s.reserved FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1)))
SELECT user_id, event_id, got FROM s WHERE r > 0""")
def device_slots(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", r.alias("r"), (F.col("event_id") % 6).alias("n"))
    op = F.when(F.col("r") <= 2, "reserve").when(F.col("event_type") == "error", "free").otherwise("take")
    slot = F.when(F.col("r") <= 2, ((F.col("r") - 1) * 2).cast("bigint")).when(F.col("event_type").isin("error", "click"), F.col("n"))
    return state.allocate_slots(e.select("user_id", "event_id", op.alias("op"), slot.alias("slot")), ["user_id"], ["event_id"], "device", 8).select("user_id", "event_id", "got")


@query("""WITH RECURSIVE q AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'pop' WHEN 'error' THEN 'rst' ELSE 'rx' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS result, CAST([] AS BIGINT[]) AS items, CAST([] AS VARCHAR[]) AS kinds, true AS synced FROM q
  UNION ALL SELECT user_id, r, event_id, CASE WHEN kind = 'pop' THEN CAST(items[1] AS VARCHAR) WHEN room THEN 'queued' WHEN at_ IS NOT NULL THEN 'replaced' ELSE 'dropped' END,
    CASE WHEN kind = 'pop' THEN items[2:] WHEN room THEN list_append(items, event_id) WHEN at_ IS NOT NULL THEN list_transform(items, lambda x, i: CASE WHEN i = at_ THEN event_id ELSE x END) ELSE items END,
    CASE WHEN kind = 'pop' THEN kinds[2:] WHEN room THEN list_append(kinds, kind) WHEN at_ IS NOT NULL THEN list_transform(kinds, lambda x, i: CASE WHEN i = at_ THEN kind ELSE x END) ELSE kinds END, synced AND (kind = 'pop' OR room)
  FROM (SELECT *, CASE WHEN kind = 'rst' THEN list_max(list_filter(range(1, len(kinds) + 1), lambda i: kinds[i] = 'rx')) END AS at_, len(items) < 3 AS room FROM (SELECT q.*, s.items, s.kinds, s.synced FROM s JOIN q ON q.user_id = s.user_id AND q.r = s.r + 1)))
SELECT user_id, event_id, result, synced FROM s WHERE r > 0""")
def eviction_queue(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "pop").when(F.col("event_type") == "error", "rst").otherwise("rx")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.col("event_id").cast("string").alias("item"))
    return state.bounded_queue(events, ["user_id"], ["event_id"], 3).select("user_id", "event_id", "result", "synced")


@query()
def expiry_queue(spark, sf_dir):
    """Recursion over a queue that is made anew within a step is beyond plain SQL; tests hold it against a model of its own."""
    op = F.when(F.col("event_type") == "view", "poll").when(F.col("event_type") == "error", "disarm").otherwise("arm")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", op.alias("op"), (F.col("event_id") % 9).cast("string").alias("item"))
    return state.expire(events, ["user_id"], ["event_id"], "event_id", 100, 3)


@query("""WITH m AS (SELECT user_id, event_id, event_type, event_id % 3 AS word, CAST(1 AS BIGINT) << CAST(event_id % 50 AS INT) AS bits FROM events), r AS (SELECT user_id, event_id AS read FROM m WHERE event_type = 'view'),
f AS (SELECT m.user_id, min(r.read) AS read, m.word, m.bits, m.event_id FROM m JOIN r ON r.user_id = m.user_id AND r.read > m.event_id WHERE m.event_type IN ('click', 'error') GROUP BY m.user_id, m.word, m.bits, m.event_id)
SELECT user_id, read, word, bit_or(bits) AS bits FROM f GROUP BY 1, 2, 3""")
def dirty_reads(spark, sf_dir):
    op = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "vm").when(F.col("event_type") == "error", "vmm")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", op.alias("op"), (F.col("event_id") % 3).alias("word"), F.expr("shiftleft(1L, CAST(event_id % 50 AS INT))").alias("bits")).where("op IS NOT NULL")
    return state.read_and_reset(events, ["user_id"], "event_id")


@query("""WITH RECURSIVE p AS (SELECT user_id, r, (r // 4) % 3 * 8192 AS page, r % 2 AS sub FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS cur, CAST([] AS BIGINT[]) AS seen FROM p
  UNION ALL SELECT user_id, r, CASE WHEN len(now_) = 2 THEN page END, CASE WHEN len(now_) = 2 THEN NULL ELSE page END, CASE WHEN len(now_) = 2 THEN [] ELSE now_ END
  FROM (SELECT p.*, list_distinct(list_append(CASE WHEN s.cur IS NOT DISTINCT FROM p.page THEN s.seen ELSE [] END, p.sub)) AS now_ FROM s JOIN p ON p.user_id = s.user_id AND p.r = s.r + 1))
SELECT user_id, done AS page FROM s WHERE done IS NOT NULL""")
def pages_in_order(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", r.cast("bigint").alias("r")).withColumn("addr", F.expr("(r div 4) % 3 * 8192 + r % 2 * 4096"))
    return aggregates.complete_pages_in_order(rows, ["user_id"], ["event_id"], "addr", 8192)
