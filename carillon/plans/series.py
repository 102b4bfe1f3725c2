"""Series queries. A user's events are a sample stream: frames by time, then id; the value is the sample."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carillon.functions import audio as A
from carillon.functions.text import within_track_ms
from carillon.operators import series as S
from carillon.operators import temporal as T
from carillon.operators import transitions as X
from carillon.tables import load

RATE = 11


def _frames(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(s, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("frame"), (F.col("value") / 500.0).alias("x"))


def wave_buckets(s, d):
    return S.wave_buckets(_frames(s, d), "user_id", "frame", "x", RATE)


def wave_downsample(s, d):
    got = S.downsample(S.wave_buckets(_frames(s, d), "user_id", "frame", "x", RATE), "user_id", "bucket", "peak", "rms", 24)
    return got.select("user_id", F.col("column").cast("bigint").alias("col"), "peak", "rms")


def wave_upsample(s, d):
    """In 200 columns, which for many streams are more than they have points: those repeat theirs."""
    got = S.downsample(S.wave_buckets(_frames(s, d), "user_id", "frame", "x", RATE), "user_id", "bucket", "peak", "rms", 200)
    return got.select("user_id", F.col("column").cast("bigint").alias("col"), "peak", "rms")


def gated_mean(s, d):
    got = S.gated_loudness(_frames(s, d), "user_id", "frame", "x", 5)
    return got.select("user_id", "n_blocks", F.round("lufs", 6).alias("lufs"))


def peak_level(s, d):
    got = _frames(s, d).groupBy("user_id").agg(F.max(F.abs("x")).alias("p"))
    return got.select("user_id", F.round(A.db(F.col("p")), 6).alias("peak_db"), F.round(A.normalization_gain(A.db(F.col("p")) - 20, A.db(F.col("p"))), 6).alias("gain"))


def resample_linear(s, d):
    got = S.resample(_frames(s, d), "user_id", "frame", "x", 3, 5)
    return got.select("user_id", "frame", F.round("value", 7).alias("value"))


def patch_windows(s, d):
    n = _frames(s, d).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = [n.select("user_id", F.lit(p).alias("policy"), F.explode(S.patch_starts(F.col("n"), 18, 7, p)).alias("start")) for p in ("drop", "pad", "end")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _tails(s, d):
    """Each user's last 24 values, oldest first, and first 4."""
    w = Window.partitionBy("user_id")
    f = _frames(s, d).withColumn("n", F.count(F.lit(1)).over(w))
    last = f.where("frame >= n - 24").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda v: v["x"]).alias("tail"), F.max("n").alias("n"))
    first = f.where("frame < 4").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda v: v["x"]).alias("head"))
    return last.join(first, "user_id")


def tail_stats(s, d):
    t = F.col("tail")
    return _tails(s, d).select("user_id", F.round(X.trailing_silence(t, 0.1), 4).alias("silence"), F.round(X.decay(t, 0.1), 4).alias("decay"), X.clean_loud_ending(t, 0.1).alias("loud"), X.fast_attack(F.col("head"), 0.1).alias("attack"))


def transitions(s, d):
    """How each user's stream would be joined to the next user's."""
    a = _tails(s, d)
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("head").alias("next_head"), F.col("n").alias("next_n"))
    p = X.plan(F.col("tail"), F.col("next_head"), F.col("n") / 10.0, F.col("next_n") / 10.0, F.lit(8.0), F.lit(False), F.col("user_id") % 3 == 0, 0.1)
    return a.join(b, "user_id", "left").select("user_id", p["kind"].alias("kind"), F.round(p["seconds"], 2).alias("seconds"))


def normalized_head(s, d):
    """The first four values over the largest of them."""
    return _tails(s, d).select("user_id", F.posexplode(F.transform("head", lambda x: F.round(F.try_divide(x, F.array_max("head")), 6))).alias("pos", "value"))


def fill_missing(s, d):
    """Streams of under 24 values brought to 24 in three ways; the sum tells them apart."""
    f = _tails(s, d).select("user_id", F.slice("tail", 1, 5).alias("v"))
    total = lambda p: F.round(F.aggregate(S.fill(F.col("v"), 24, p), F.lit(0.0), lambda a, x: a + x), 6)
    return f.select("user_id", total("zero").alias("zero"), total("repeat").alias("repeat"), total("reflect").alias("reflect"))


def mix_overlap(s, d):
    f = _frames(s, d)
    got = S.overlap(f.where("user_id % 2 = 0").withColumn("k", F.floor(F.col("user_id") / 2)), f.where("user_id % 2 = 1").withColumn("k", F.floor(F.col("user_id") / 2)), "k", "frame", "x", 20, 16)
    return got.select("k", "frame", F.round("value", 6).alias("value"))


def prefix_position(s, d):
    """Where each line of an order starts when lengths are laid end to end."""
    l = load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("length"))
    return T.prefix_positions(l, "l_orderkey", ["l_linenumber"], "length").select("l_orderkey", "l_linenumber", F.col("start").cast("bigint").alias("start"))


def position_lookup(s, d):
    """The line of each order that holds position 40, by as-of over the starts; the first one where 40 lies before."""
    l = load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("length"))
    p = T.prefix_positions(l, "l_orderkey", ["l_linenumber"], "length")
    ask = p.select("l_orderkey").distinct().withColumn("pos", F.lit(40).cast("bigint"))
    got = T.as_of(ask, p.select("l_orderkey", "start", "l_linenumber", "length"), ["l_orderkey"], "pos", "start", "l_linenumber", ["l_linenumber", "start", "length"])
    return got.select("l_orderkey", "l_linenumber", F.greatest(F.lit(0), F.col("start") + F.col("length") - F.col("pos")).cast("bigint").alias("remaining"))


def asof_active(s, d):
    """Each click with the user's last view at or before it."""
    e = load(s, d, "events")
    left = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("view_id"))
    got = T.as_of(left, right, ["user_id"], "ts", "at", "view_id", ["view_id"])
    return got.select("event_id", "view_id")


def event_sessions(s, d):
    got = T.sessions(load(s, d, "events"), "user_id", "ts", 1800)
    return got.select("user_id", F.col("first_at").cast("string").alias("first_at"), "n")


def hopping_windows(s, d):
    """Complete windows of four days, one a day, per event type."""
    e = load(s, d, "events").select("event_type", F.col("ts").cast("date").alias("day"), "value")
    per = e.groupBy("event_type", "day").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-3, 0)
    span = F.datediff("day", F.min("day").over(w))
    return per.withColumn("sv", F.sum("v").over(w)).withColumn("sn", F.sum("n").over(w)).withColumn("k", F.count(F.lit(1)).over(w)).withColumn("span", span).where("k = 4 and span = 3").select("event_type", F.col("day").cast("string").alias("day"), F.round("sv", 4).alias("total"), F.col("sn").alias("n"))


def audio_scalars(s, d):
    x = F.col("value") / 500.0
    a, b = A.equal_power(x)
    return load(s, d, "events").select("event_id", A.quantize_amplitude(x).alias("q"), F.round(A.db_to_linear(-x * 30), 8).alias("lin"), F.round(a, 7).alias("ga"), F.round(b, 7).alias("gb"), within_track_ms(F.col("value"), F.lit(10.0), F.lit(300.0)).alias("ms"))


def loudness_facts(s, d):
    """Tracks with a valid loudness, and the gain that brings them to the target under the peak ceiling."""
    t = load(s, d, "tracks").withColumn("lufs", F.when(F.col("has_loudness") == 1, F.col("loudness_lufs"))).withColumn("peak", F.when(F.col("has_loudness") == 1, F.col("loudness_true_peak_db")))
    return t.select("id", A.valid_loudness(F.col("lufs")).alias("valid"), F.round(A.normalization_gain(F.col("lufs"), F.col("peak")), 6).alias("gain"))


QUERIES = {f.__name__: f for f in (
    wave_buckets, wave_downsample, wave_upsample, gated_mean, peak_level, resample_linear, patch_windows, tail_stats, transitions, normalized_head, fill_missing, mix_overlap,
    prefix_position, position_lookup, asof_active, event_sessions, hopping_windows, audio_scalars, loudness_facts,
)}

_F = "f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 500.0 AS x FROM events)"
_Q = "(CASE WHEN {0} <= 0 THEN 0 WHEN {0} >= 1 THEN 255 ELSE greatest(1, least(255, round((20 * log10({0}) + 60) / 60 * 254) + 1)) END)::INT"
_B = f"b AS (SELECT user_id, frame * 10 // {RATE} AS bucket, {_Q.format('max(abs(x))')} peak, {_Q.format('sqrt(avg(x * x))')} rms FROM f GROUP BY 1, 2)"
_T = """t AS (SELECT user_id, list(x ORDER BY frame) FILTER (frame >= n - 24) tail, list(x ORDER BY frame) FILTER (frame < 4) head, max(n) n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) n FROM f) GROUP BY 1),
m AS (SELECT *, greatest(0.02, 0.25 * list_median(tail)) fl, list_median(tail) md, greatest(0.02, 0.25 * list_median(head)) hfl FROM (SELECT *, list_aggregate(tail, 'median') AS list_median_tail FROM t)),
st AS (SELECT *, (len(tail) - coalesce(list_max(list_transform(generate_series(1, len(tail)), lambda i: CASE WHEN tail[i] >= 0.02 THEN i ELSE 0 END)), 0)) * 0.1::DOUBLE silence,
 (len(tail) - coalesce(list_max(list_transform(generate_series(1, len(tail)), lambda i: CASE WHEN tail[i] >= fl THEN i ELSE 0 END)), 0)) * 0.1::DOUBLE decay,
 tail[-1] >= fl AND len(list_filter(tail[greatest(1, len(tail) - 19):], lambda x: x < 0.25 * md)) = 0 loud,
 len(list_filter(head[1:3], lambda x: x >= hfl)) > 0 attack FROM m)""".replace("list_median(tail)", "list_aggregate(tail, 'median')").replace("list_median(head)", "list_aggregate(head, 'median')").replace(", list_aggregate(tail, 'median') AS list_median_tail", "")
_L = "l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS length FROM lineitem GROUP BY 1, 2), p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)"
SQL = {
    "wave_buckets": f"WITH {_F}, {_B} SELECT * FROM b",
    "wave_downsample": f"WITH {_F}, {_B}, n AS (SELECT user_id, max(bucket) + 1 AS n FROM b GROUP BY 1), c AS (SELECT user_id, range AS col, CASE WHEN 24 >= n THEN least(n - 1, range * n // 24) ELSE range * n // 24 END lo, CASE WHEN 24 >= n THEN least(n - 1, range * n // 24) + 1 ELSE greatest(range * n // 24 + 1, (range + 1) * n // 24) END hi FROM n, range(24)) SELECT user_id, col, max(peak) peak, round(sqrt(avg(rms::DOUBLE * rms)))::INT rms FROM c JOIN b USING (user_id) WHERE bucket >= lo AND bucket < hi GROUP BY 1, 2",
    "gated_mean": f"WITH {_F}, s AS (SELECT user_id, frame // 5 AS s, sum(x * x) e, count(*) n FROM f GROUP BY 1, 2), w AS (SELECT user_id, sum(e) OVER q / 20 AS e, sum(n) OVER q AS n FROM s WINDOW q AS (PARTITION BY user_id ORDER BY s ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), k AS (SELECT * FROM w WHERE n = 20 AND e >= pow(10, (-70 + 0.691) / 10)), g AS (SELECT user_id, e FROM (SELECT *, avg(e) OVER (PARTITION BY user_id) AS m FROM k) WHERE e >= 0.1 * m), r AS (SELECT user_id, count(*) n_blocks, avg(e) e FROM g GROUP BY 1) SELECT u.user_id, coalesce(n_blocks, 0) n_blocks, round(coalesce(greatest(-70, 10 * log10(e) - 0.691), -70), 6) lufs FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON r.user_id = u.user_id",
    "peak_level": f"WITH {_F}, p AS (SELECT user_id, greatest(-70, 20 * log10(max(abs(x)))) db FROM f GROUP BY 1) SELECT user_id, round(db, 6) peak_db, round(least(-16 - (db - 20), -1 - db), 6) gain FROM p",
    "resample_linear": f"WITH {_F}, n AS (SELECT user_id, count(*) n FROM f GROUP BY 1), j AS (SELECT user_id, n, unnest(range((n * 5 + 2) // 3)) AS frame FROM n), k AS (SELECT *, frame * 3 // 5 AS k, frame * 3.0::DOUBLE / 5.0 - frame * 3 // 5 AS fr FROM j) SELECT k.user_id, k.frame, round(a.x + (b.x - a.x) * fr, 7) AS value FROM k JOIN f a ON a.user_id = k.user_id AND a.frame = k JOIN f b ON b.user_id = k.user_id AND b.frame = least(k + 1, n - 1)",
    "patch_windows": f"""WITH {_F}, n AS (SELECT user_id, count(*)::INT n FROM f GROUP BY 1), w AS (SELECT user_id, n, unnest(CASE WHEN n >= 18 THEN range(0, n - 17, 7) ELSE [] END)::INT AS start FROM n), l AS (SELECT n.user_id, n.n, max(start) AS last FROM n LEFT JOIN w ON w.user_id = n.user_id GROUP BY 1, 2)
        SELECT user_id, p AS policy, start FROM w, (VALUES ('drop'), ('pad'), ('end')) t(p) UNION ALL SELECT user_id, 'pad', coalesce(last + 7, 0)::INT FROM l WHERE coalesce(last + 18, 0) < n UNION ALL SELECT user_id, 'end', (n - 18)::INT FROM l WHERE n >= 18 AND last + 18 < n""",
    "tail_stats": f"WITH {_F}, {_T} SELECT user_id, round(silence, 4) silence, round(decay, 4) decay, loud, attack FROM st",
    "transitions": f"""WITH {_F}, {_T}, x AS (SELECT a.user_id, a.silence, a.decay, a.loud, a.n / 10.0::DOUBLE AS ol, b.n / 10.0::DOUBLE AS il, b.head nh, b.attack FROM st a LEFT JOIN st b ON b.user_id = a.user_id + 1),
        y AS (SELECT *, CASE WHEN nh IS NULL THEN 'fade' WHEN silence >= 1.2 THEN 'gapless' WHEN user_id % 3 = 0 AND loud THEN 'gapless' WHEN loud AND attack THEN 'hard_cut' ELSE 'fade' END kind FROM x)
        SELECT user_id, kind, CASE WHEN kind = 'fade' THEN CASE WHEN nh IS NULL THEN 8.0 ELSE round(greatest(0, least(greatest(1.0, least(6.0, decay + 0.5)), ol / 2, il / 2)), 2) END END::DOUBLE AS seconds FROM y""",
    "normalized_head": f"WITH {_F}, h AS (SELECT user_id, frame, x, max(x) OVER (PARTITION BY user_id) m FROM f WHERE frame < 4) SELECT user_id, frame::INT AS pos, round(x / m, 6) AS value FROM h",
    "fill_missing": f"""WITH {_F}, {_T}, v AS (SELECT user_id, tail[1:5] v, len(tail[1:5]) n FROM t) SELECT user_id, round(list_sum(v), 6) AS zero, round(list_sum(list_transform(range(24), lambda i: v[least(i, n - 1) + 1])), 6) AS repeat,
        round(list_sum(list_transform(range(24), lambda i: v[least(i % greatest(1, 2 * n - 2), greatest(1, 2 * n - 2) - i % greatest(1, 2 * n - 2)) + 1])), 6) AS reflect FROM v""",
    "mix_overlap": f"WITH {_F}, a AS (SELECT user_id // 2 AS k, frame - 20 AS frame, x FROM f WHERE user_id % 2 = 0 AND frame >= 20 AND frame < 36), b AS (SELECT user_id // 2 AS k, frame, x FROM f WHERE user_id % 2 = 1 AND frame < 16) SELECT coalesce(a.k, b.k) k, coalesce(a.frame, b.frame) frame, round(coalesce(a.x, 0) * cos(coalesce(a.frame, b.frame) / 16.0::DOUBLE * pi() / 2) + coalesce(b.x, 0) * sin(coalesce(a.frame, b.frame) / 16.0::DOUBLE * pi() / 2), 6) AS value FROM a FULL JOIN b ON a.k = b.k AND a.frame = b.frame",
    "prefix_position": f"WITH {_L} SELECT l_orderkey, l_linenumber, start FROM p",
    "position_lookup": f"WITH {_L} SELECT l_orderkey, l_linenumber, greatest(0, start + length - 40)::BIGINT remaining FROM p WHERE start <= 40 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY start DESC, l_linenumber DESC) = 1",
    "asof_active": "WITH c AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(event_id) view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT c.event_id, v.view_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1800 SECONDS THEN 0 ELSE 1 END nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) k FROM g) SELECT user_id, min(ts)::VARCHAR first_at, count(*) n FROM s GROUP BY user_id, k",
    "hopping_windows": "WITH p AS (SELECT event_type, ts::DATE AS day, sum(value) v, count(*) n FROM events GROUP BY 1, 2), w AS (SELECT event_type, day, sum(v) OVER q sv, sum(n) OVER q sn, count(*) OVER q k, day - min(day) OVER q AS span FROM p WINDOW q AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT event_type, day::VARCHAR AS day, round(sv, 4) total, sn::BIGINT AS n FROM w WHERE k = 4 AND span = 3",
    "audio_scalars": f"SELECT event_id, {_Q.format('(value / 500.0)')} q, round(pow(10, -value / 500.0 * 30 / 20), 8) lin, round(cos(least(1, value / 500.0) * pi() / 2), 7) ga, round(sin(least(1, value / 500.0) * pi() / 2), 7) gb, floor(greatest(0, least(value, 300) - 10) * 1000)::BIGINT ms FROM events",
    "loudness_facts": "WITH t AS (SELECT id, CASE WHEN has_loudness = 1 THEN loudness_lufs END l, CASE WHEN has_loudness = 1 THEN loudness_true_peak_db END p FROM tracks) SELECT id, coalesce(NOT isnan(l) AND l BETWEEN -70 AND 6, false) AS valid, round(CASE WHEN l IS NULL OR isnan(l) THEN 0 WHEN p IS NULL OR isnan(p) THEN -16 - l ELSE least(-16 - l, -1 - p) END, 6) gain FROM t",
}
SQL["wave_upsample"] = SQL["wave_downsample"].replace("24", "200")
