"""More registered queries: validity rules, compositions, lookups and tables with gaps, over columns derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import scalars as S
from ..operators import checks, compare, features, fits, lookups, ordered, splits
from .queries import RATIOS, SPLITS_SQL, _events, _labelled
from .registry import query, rounded, t

NULL_STRATUM_SQL = f"""{SPLITS_SQL},
d AS (SELECT CAST(doc_id AS VARCHAR) sample_id, CASE WHEN doc_id % 4 > 0 THEN lang END stratum FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || coalesce(stratum, '') || ':' || sample_id)) position FROM d),
n AS (SELECT stratum, count(*) n FROM d GROUP BY 1), k AS (SELECT stratum, o, split, q * n qn, unnest(range(0, CAST(ceil(q * n) AS BIGINT) + 2)) k FROM n, r),
s AS (SELECT stratum, split, row_number() OVER (PARTITION BY stratum ORDER BY k - qn, o) position FROM k)"""


def _gapped(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("lang"))


@query(f"WITH {NULL_STRATUM_SQL} SELECT p.sample_id, p.stratum, s.split FROM p JOIN s ON p.position = s.position AND p.stratum IS NOT DISTINCT FROM s.stratum")
def split_null_stratum(spark, sf):
    """Rows without a stratum are one of their own."""
    return splits.split_rows(_gapped(spark, sf), "doc_id", RATIOS, 42, "lang")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN lang END lang, row_number() OVER (PARTITION BY CASE WHEN doc_id % 4 > 0 THEN lang END ORDER BY n_chars, doc_id) rank FROM documents""")
def rank_with_null_groups(spark, sf):
    return ordered.with_rank(_gapped(spark, sf), ["lang"], F.col("n_chars"), F.col("doc_id")).select("doc_id", "lang", "rank")


@query(
    """WITH g AS (SELECT CASE WHEN doc_id % 4 > 0 THEN lang END lang, (n_chars // 500)::DOUBLE "key", count(*) n FROM documents GROUP BY 1, 2)
SELECT lang, "key", sum(n) OVER (PARTITION BY lang ORDER BY "key")::BIGINT run_n FROM g"""
)
def running_sums_with_null_groups(spark, sf):
    counts = _gapped(spark, sf).groupBy("lang", F.floor(F.col("n_chars") / 500).cast("double").alias("key")).agg(F.count("*").alias("n"))
    return ordered.running_sums(counts, ["lang"], "key", ["n"]).drop("n")


@query(
    """WITH x AS (SELECT o_orderkey id, o_totalprice / 100 - 1500 e, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'inf'::DOUBLE ELSE 0.2 * (o_totalprice / 100 - 1500) END z,
 (o_orderkey % 5 + 2)::INT n, CASE WHEN o_orderkey % 17 = 0 THEN 'nan'::DOUBLE ELSE (o_orderkey % 7)::DOUBLE END m FROM orders),
y AS (SELECT id, CASE WHEN id % 19 = 0 THEN NULL ELSE e END e, z, n, m, 0.25 * n * m * m + 0.5 * n bound FROM x),
r AS (SELECT id, CASE WHEN e IS NULL THEN 'energy isn''t finite' WHEN abs(e / n) > 100 THEN 'energy a site is too large'
  WHEN z IS NOT NULL AND isfinite(z) AND isfinite(m) AND e - z < -bound THEN 'gain is more than exchange allows' END energy,
 CASE WHEN NOT isfinite(m) THEN 'a moment isn''t finite' END bad,
 CASE WHEN isfinite(m) AND m > 1.05::DOUBLE * 4.5 THEN array_to_string(list_transform(range(0, n, 2), lambda i: 'site ' || i || ' Fe is over its limit'), ';') END sites FROM y)
SELECT id, concat_ws(';', energy, bad, sites) reasons, CASE WHEN energy IS NULL AND bad IS NULL AND sites IS NULL THEN 'valid' ELSE 'invalid' END status FROM r"""
)
def relaxation_validity(spark, sf):
    """Sites are Fe, with a limit, and O, without, in turn; energies and moments have gaps."""
    key, e = F.col("o_orderkey"), F.col("o_totalprice") / 100 - 1500
    n = (key % 5 + 2).cast("int")
    m = F.when(key % 17 == 0, F.lit(float("nan"))).otherwise((key % 7).cast("double"))
    zero = F.when(key % 11 == 0, F.lit(None).cast("double")).when(key % 13 == 0, F.lit(float("inf"))).otherwise(F.lit(0.2) * e)
    site = F.sequence(F.lit(0), n - 1)
    rows = t(spark, sf, "orders").select(
        key.alias("id"), F.when(key % 19 != 0, e).alias("energy"), zero.alias("zero_energy"), F.transform(site, lambda i: F.array(F.lit(0.0), F.lit(0.0), m)).alias("moments"),
        F.transform(site, lambda i: F.when(i % 2 == 0, "Fe").otherwise("O")).alias("symbols"), F.create_map(F.lit("Fe"), F.lit(4.5)).alias("limits"),
    )
    return checks.relaxation_reasons(rows).select("id", F.concat_ws(";", "reasons").alias("reasons"), "status")


@query("SELECT o_orderkey id, round((o_totalprice - o_totalprice * 0.5) / (o_orderkey % 5 + 2), 6) gain FROM orders")
def energy_gains(spark, sf):
    gain = checks.energy_gain(F.col("o_totalprice"), F.col("o_totalprice") * F.lit(0.5), F.col("o_orderkey") % 5 + 2)
    return rounded(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), gain.alias("gain")), 6)


# neutral atoms of the query below: element, n, shell and electrons
ORBITALS = [("Fe", 3, "d", 6), ("Fe", 4, "s", 2), ("Gd", 4, "f", 7), ("Gd", 5, "d", 1), ("Gd", 6, "s", 2), ("Yb", 4, "f", 14), ("Yb", 6, "s", 2), ("Zn", 3, "d", 10), ("Zn", 4, "s", 2), ("O", 2, "p", 4)]
ELEMENT_SQL = "CASE p_partkey % 6 WHEN 0 THEN 'Fe' WHEN 1 THEN 'Gd' WHEN 2 THEN 'Yb' WHEN 3 THEN 'Zn' WHEN 4 THEN 'O' END"


@query(
    f"""WITH x AS (SELECT p_partkey, {ELEMENT_SQL} el, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 9 - 2.5::DOUBLE END ox, CASE WHEN p_partkey % 8 > 0 THEN p_size / 5.0::DOUBLE END lim FROM part),
o(el, cap, e, outr) AS (VALUES ('Fe', 10, 6, 2), ('Gd', 14, 7, 3), ('Zn', 10, 10, 2)),
s AS (SELECT p_partkey, lim, cap, least(greatest(e - CASE WHEN coalesce(ox, 0) >= 0 THEN greatest(coalesce(ox, 0) - outr, 0) ELSE ox END, 0), cap) n FROM x LEFT JOIN o USING (el))
SELECT p_partkey, round(CASE WHEN n IS NULL OR lim IS NULL THEN 0 ELSE least(n, cap - n, 0.7::DOUBLE * lim) END, 9)::DOUBLE moment FROM s"""
)
def seed_moments(spark, sf):
    """Open f shells, d shells, full f shells without a d shell, and elements with neither."""
    table = spark.createDataFrame(ORBITALS, "element string, n int, shell string, electrons int")
    atoms = table.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("n", "shell", "electrons"))).alias("orbitals"))
    k = F.col("p_partkey") % 6
    element = F.when(k == 0, "Fe").when(k == 1, "Gd").when(k == 2, "Yb").when(k == 3, "Zn").when(k == 4, "O")
    rows = t(spark, sf, "part").select(
        "p_partkey", element.alias("element"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 9 - F.lit(2.5)).alias("oxidation"),
        F.when(F.col("p_partkey") % 8 > 0, F.col("p_size") / F.lit(5.0)).alias("limit"),
    )
    moment = features.seed_moment(F.col("orbitals"), F.col("oxidation"), F.col("limit"))
    return rounded(rows.join(F.broadcast(atoms), "element", "left").select("p_partkey", moment.alias("moment")))


@query(
    """WITH e AS (SELECT l_orderkey k, l_linenumber el, l_quantity q FROM lineitem), w AS (SELECT l_linenumber el, CASE WHEN l_linenumber <> 6 THEN l_linenumber * 1.5 END w FROM lineitem WHERE l_linenumber < 7 GROUP BY 1),
j AS (SELECT o_orderkey k, q, w, e.k IS NOT NULL has FROM orders LEFT JOIN e ON e.k = o_orderkey LEFT JOIN w USING (el))
SELECT k, round(CASE WHEN count(w) = count(*) THEN sum(w * q) / sum(q) END, 9) w_mean, CASE WHEN count(w) = count(*) THEN min(w) END::DOUBLE w_min,
CASE WHEN count(w) = count(*) THEN max(w) END::DOUBLE w_max, CASE WHEN count(w) = count(*) THEN max(w) - min(w) END::DOUBLE w_range FROM j GROUP BY 1"""
)
def composition_features(spark, sf):
    """Orders as compositions of line numbers; the sixth has no weight and the seventh isn't known."""
    items = t(spark, sf, "lineitem")
    parts = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("element"), F.col("l_quantity").alias("amount"))
    known = items.select(F.col("l_linenumber").alias("element")).distinct().filter("element < 7").withColumn("w", F.when(F.col("element") != 6, F.col("element") * F.lit(1.5)))
    return rounded(features.composition_stats(t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k", parts, known, ["w"]))


@query(
    """WITH e AS (SELECT l_orderkey k, l_linenumber el, sum(l_quantity)::DOUBLE q FROM lineitem GROUP BY 1, 2), w AS (SELECT *, q / sum(q) OVER (PARTITION BY k) w,
 sqrt(el) a, CASE WHEN el <> 6 THEN sqrt(el + 3) END b, (el % 3)::DOUBLE s, (el // 3)::DOUBLE d FROM e),
m AS (SELECT k, bool_and(el < 7) known, count(*) n, sum(w * a) ma, sum(w * b) mb, count(b) = count(*) hasb, sum(w * s) ms, sum(w * d) md, max(w) top FROM w GROUP BY k),
x AS (SELECT k, any_value(known) known, any_value(hasb) hasb, any_value(n)::DOUBLE n, sqrt(sum(w * w)) n2, sum(w ** 10) ** 0.1 n10, min(a) mina, max(a) maxa, any_value(ma) ma, sum(abs(a - ma) * w) da, min(a) FILTER (w >= top - 1e-12) moda,
 min(b) minb, max(b) maxb, any_value(mb) mb, sum(abs(b - mb) * w) db, min(b) FILTER (w >= top - 1e-12) modb, any_value(ms) ms, any_value(md) md FROM w JOIN m USING (k) GROUP BY k)
SELECT o_orderkey k, CASE WHEN known THEN n END norm_0, CASE WHEN known THEN round(n2, 9) END norm_2, CASE WHEN known THEN round(n10, 9) END norm_10, CASE WHEN known THEN round(mina, 9) END a_minimum, CASE WHEN known THEN round(maxa, 9) END a_maximum,
 CASE WHEN known THEN round(maxa - mina, 9) END a_range, CASE WHEN known THEN round(ma, 9) END a_mean, CASE WHEN known THEN round(da, 9) END a_avg_dev, CASE WHEN known THEN round(moda, 9) END a_mode, CASE WHEN known AND hasb THEN round(mb, 9) END b_mean,
 CASE WHEN known AND hasb THEN round(db, 9) END b_avg_dev, CASE WHEN known AND hasb THEN round(modb, 9) END b_mode, CASE WHEN known THEN round(ms, 9) END s_avg, CASE WHEN known THEN CASE WHEN ms + md > 0 THEN round(ms / (ms + md), 9) ELSE 0 END END s_frac,
 CASE WHEN known THEN CASE WHEN ms + md > 0 THEN round(md / (ms + md), 9) ELSE 0 END END d_frac FROM orders LEFT JOIN x ON k = o_orderkey"""
)
def composition_blocks(spark, sf):
    """Orders as compositions of line numbers: the seventh isn't known, the sixth lacks a property."""
    items, n = t(spark, sf, "lineitem"), F.col("element").cast("double")
    parts = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("element"), F.col("l_quantity").alias("amount"))
    known = parts.select("element").distinct().filter("element < 7").select("element", F.sqrt(n).alias("a"), F.when(n != 6, F.sqrt(n + 3)).alias("b"), (n % 3).alias("s"), F.floor(n / 3).cast("double").alias("d"))
    found = features.composition_block(t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k", parts, known, ["a", "b"], ["s", "d"])
    return rounded(found.select("k", "norm_0", "norm_2", "norm_10", "a_minimum", "a_maximum", "a_range", "a_mean", "a_avg_dev", "a_mode", "b_mean", "b_avg_dev", "b_mode", "s_avg", "s_frac", "d_frac"), 9)


@query(
    """WITH RECURSIVE s AS (SELECT l_orderkey k, 'E' || l_linenumber el, sum(l_quantity * 2) q FROM lineitem WHERE l_orderkey % 3 <> 2 GROUP BY 1, 2
 UNION ALL SELECT l_orderkey, 'E' || l_linenumber, sum(l_quantity / 4) FROM lineitem WHERE l_orderkey % 3 = 2 GROUP BY 1, 2),
b AS (SELECT k, list(q ORDER BY el) q, bool_and(q = floor(q)) whole FROM s GROUP BY 1),
g AS (SELECT k, CASE WHEN whole THEN list_reduce(list_transform(q, lambda x: x::BIGINT), lambda a, b: gcd(a, b)) END d FROM b)
SELECT k, string_agg(el || CASE WHEN d IS NULL THEN CASE WHEN q = 1 THEN '' ELSE regexp_replace(printf('%.6f', q), '\\.?0+$', '') END WHEN q = d THEN '' ELSE (q / d)::BIGINT::VARCHAR END, '' ORDER BY el) formula FROM s JOIN g USING (k) GROUP BY k"""
)
def formulas(spark, sf):
    """Whole amounts are reduced; where one is a fraction all are written as they are."""
    amount = F.when(F.col("l_orderkey") % 3 == 2, F.col("l_quantity") / 4).otherwise(F.col("l_quantity") * 2)
    parts = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("E"), F.col("l_linenumber")).alias("element"), amount.alias("amount"))
    return features.reduced_formula(parts, "k")


@query(
    """WITH x AS (SELECT p_partkey, unnest(range(1, 13)) i, p_size s FROM part), m AS (SELECT p_partkey, i, (i + i * i * s // 150)::INT a, (i + (s % 5) // 4 * (i // 6))::INT b FROM x),
j AS (SELECT *, coalesce(a - lag(a) OVER w > 1, false) OR coalesce(b - lag(b) OVER w > 1, false) jump FROM m WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
c AS (SELECT *, sum(jump::INT) OVER (PARTITION BY p_partkey ORDER BY i) seen FROM j) SELECT p_partkey, i::INT i, a, b FROM c WHERE seen = 0"""
)
def ladder_until_jump(spark, sf):
    i, s = F.col("i"), F.col("p_size")
    rungs = t(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"))
    meshes = rungs.select("p_partkey", "i", (i + F.floor(i * i * s / 150)).cast("int").alias("a"), (i + F.floor((s % 5) / 4) * F.floor(i / 6)).cast("int").alias("b"))
    return features.until_jump(meshes, "p_partkey", "i", ["a", "b"])


@query(
    """WITH x AS (SELECT quality = 1 y, unnest(['length', 'source']) "system", unnest([n_chars >= 1000, source = 'src0']) p, lang FROM labels JOIN documents USING (doc_id)),
c AS (SELECT "system", lang, count(*) n, count_if(y AND p) tp, count_if(NOT y AND p) fp, count_if(y AND NOT p) fn, count_if(NOT y AND NOT p) tn FROM x GROUP BY 1, 2)
SELECT "system", lang, n, tp::BIGINT tp, fp::BIGINT fp, fn::BIGINT fn, tn::BIGINT tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) recall FROM c"""
)
def systems_compared(spark, sf):
    guesses = F.explode(F.array(*(F.struct(F.lit(n).alias("system"), g.alias("prediction")) for n, g in (("length", F.col("n_chars") >= 1000), ("source", F.col("source") == "src0")))))
    rows = _labelled(spark, sf).select("lang", (F.col("quality") == 1).alias("truth"), guesses.alias("s")).select("lang", "truth", "s.*")
    return rounded(compare.systems(rows, ["lang"], True, ["precision", "recall"]))


@query("SELECT event_id, greatest(1.5 * value, value) - value > 2 * 12.5 wide, CASE WHEN value / 100 >= 0.5 THEN 'high' ELSE 'low' END nominal FROM events WHERE value IS NOT NULL")
def interval_flags(spark, sf):
    v = F.col("truth")
    return _events(spark, sf).select("event_id", S.wide_interval(v, F.greatest(F.lit(1.5) * v, v), 12.5).alias("wide"), S.nominal_class(v / 100, "high", "low").alias("nominal"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.7976931348623157e308 WHEN 2 THEN -1.7976931348623157e308 ELSE value END::DOUBLE cleaned FROM events"""
)
def cleaned_numbers(spark, sf):
    k = F.col("event_id") % 4
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return t(spark, sf, "events").select("event_id", S.cleaned(x).alias("cleaned"))


@query("SELECT s_nationkey, k::INT k, round(s_nationkey + 0.1::DOUBLE * k, 9) AS value FROM supplier, (SELECT unnest(range(0, 25)) k) GROUP BY ALL")
def grid_points(spark, sf):
    keys = t(spark, sf, "supplier").select("s_nationkey").distinct()
    points = keys.select("s_nationkey", F.posexplode(S.grid(0.0, 0.1, 25)).alias("k", "step"))
    return rounded(points.select("s_nationkey", "k", (F.col("s_nationkey") + F.col("step")).alias("value")))


@query("SELECT count(DISTINCT o_orderstatus) classes, count_if(o_orderstatus = 'P') > 0 has_positive FROM orders")
def class_check(spark, sf):
    return checks.two_classes(t(spark, sf, "orders"), "o_orderstatus", "P")


@query(
    """WITH f0 AS (SELECT vec_id, CASE WHEN vec_id % 31 = 0 THEN embedding[1:63] WHEN vec_id % 37 = 0 THEN list_append(embedding[1:63], 'nan'::FLOAT) WHEN vec_id % 41 = 0 THEN list_append(embedding[1:63], NULL) ELSE embedding END e FROM embeddings WHERE vec_id % 29 <> 0),
f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE vec_id % 43 = 1)
SELECT (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM f)) missing_rows, count(*) - count(DISTINCT vec_id) repeated_ids, count_if(len(e) <> 64)::BIGINT wrong_widths,
count_if(len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) > 0)::BIGINT not_finite FROM f"""
)
def feature_checks(spark, sf):
    """Over features with every kind of violation."""
    vectors, k = t(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding"), F.col("sample_id")
    cut = F.slice("embedding", 1, 63)
    broken = F.when(k % 31 == 0, cut).when(k % 37 == 0, F.concat(cut, F.array(F.lit(float("nan")).cast("float")))).when(k % 41 == 0, F.concat(cut, F.array(F.lit(None).cast("float")))).otherwise(F.col("embedding"))
    rows = vectors.filter(k % 29 != 0).select("sample_id", broken.alias("features"))
    return checks.feature_rules(vectors.select("sample_id"), rows.unionByName(rows.filter(k % 43 == 1)), 64)


@query("SELECT p_partkey, round(list_sum([p_size::DOUBLE, p_retailprice, (p_partkey % 7)::DOUBLE]), 6) total, 3 width FROM part")
def feature_blocks(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", F.array("p_size").alias("one"), F.array(F.col("p_retailprice"), (F.col("p_partkey") % 7).cast("double")).alias("two"))
    out = features.blocks(rows, ["one", "two"], 3)
    return rounded(out.select("p_partkey", F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("features").alias("width")), 6)


@query(
    """WITH a AS (SELECT doc_id k, min('a' || quality) p FROM (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE doc_id % 2 = 0) GROUP BY 1), b AS (SELECT doc_id k, 'b' || lang p FROM documents WHERE doc_id % 5 > 0)
SELECT doc_id k, coalesce(a.p, b.p) path FROM documents LEFT JOIN a ON a.k = doc_id LEFT JOIN b ON b.k = doc_id"""
)
def first_known_path(spark, sf):
    """The first source has keys twice, the second lacks some."""
    docs, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    first = labels.select(F.col("doc_id").alias("k"), F.concat(F.lit("a"), "quality").alias("path"))
    first = first.unionByName(labels.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.concat(F.lit("a"), 1 - F.col("quality")).alias("path")))
    second = docs.filter("doc_id % 5 > 0").select(F.col("doc_id").alias("k"), F.concat(F.lit("b"), "lang").alias("path"))
    return lookups.first_known(docs.select(F.col("doc_id").alias("k")), "k", first, second)


@query(
    """WITH b(band, lo, hi) AS (VALUES ('low', '-inf'::DOUBLE, 20::DOUBLE), ('middle', 20, 60), ('high', 60, 'inf')) SELECT event_id, band FROM events JOIN b ON lo <= value AND value < hi"""
)
def banded_events(spark, sf):
    bands = spark.createDataFrame([("low", None, 20.0), ("middle", 20.0, 60.0), ("high", 60.0, None)], "band string, lower double, upper double")
    return lookups.band_join(t(spark, sf, "events").select("event_id", "value"), F.col("value"), bands).select("event_id", "band")


@query(
    """WITH x AS (SELECT "label", generate_subscripts(embedding, 1) - 1 i, unnest(embedding)::DOUBLE v FROM embeddings)
SELECT "label", i AS at, count(v) n, round(avg(v), 9) mean, round(CASE WHEN stddev_pop(v) > 0.15 THEN stddev_pop(v) ELSE 1 END, 9) deviation FROM x GROUP BY 1, 2"""
)
def array_moments(spark, sf):
    """With a floor that some deviations are below."""
    found = fits.moments_of_arrays(t(spark, sf, "embeddings"), ["label"], "embedding", 0.15)
    return rounded(found.withColumn("at", F.col("at").cast("long")))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def feature_subset(spark, sf):
    return lookups.subset(t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), t(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query(
    r"""WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'k_points.k-index.qrf.' || c_nationkey || '.v' || c_custkey WHEN 1 THEN 'K.a.b.c.v1' WHEN 2 THEN 'a.b.c.v1' ELSE 'one.two.three-4.five.v' || c_nationkey END s FROM customer),
y AS (SELECT c_custkey, s, regexp_full_match(s, '[a-z0-9_-]+\.[a-z0-9_-]+\.[a-z0-9_-]+\.[a-z0-9_-]+\.v[0-9]+') ok FROM x)
SELECT c_custkey, CASE WHEN ok THEN lower(replace(string_split(s, '.')[2], '-', '_')) END module, CASE WHEN ok THEN string_split(s, '.')[5] END version FROM y"""
)
def release_names(spark, sf):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("k_points.k-index.qrf."), "c_nationkey", F.lit(".v"), "c_custkey")).when(k == 1, "K.a.b.c.v1").when(k == 2, "a.b.c.v1").otherwise(F.concat(F.lit("one.two.three-4.five.v"), "c_nationkey"))
    return t(spark, sf, "customer").select("c_custkey", S.release_module(S.release_part(name, 2)).alias("module"), S.release_part(name, 5).alias("version"))


@query(
    """SELECT l_returnflag, count(p) n, round(avg(abs(y - p)), 9) mae, round(avg((floor(p + 0.5) = y)::INT), 9) rounded_accuracy, round(avg((floor(p + 0.5) < y)::INT), 9) underprediction_rate
FROM (SELECT l_returnflag, l_quantity y, CASE WHEN l_linenumber <> 4 THEN l_quantity + (l_linenumber - 3) * 0.5::DOUBLE END p FROM lineitem) GROUP BY 1"""
)
def metrics_with_gaps(spark, sf):
    """Rows without a prediction are in no metric and not in n."""
    from ..operators import evaluate

    p = F.when(F.col("l_linenumber") != 4, F.col("l_quantity") + (F.col("l_linenumber") - 3) * F.lit(0.5))
    rows = t(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("truth"), p.alias("prediction"))
    return rounded(evaluate.regression(rows, ["mae", "rounded_accuracy", "underprediction_rate"], ["l_returnflag"]))


@query(
    """SELECT kind, count(*) n, count_if(NOT ok)::BIGINT outside FROM (SELECT 'non_negative' kind, value IS NOT NULL AND value - 10 >= 0 ok FROM events UNION ALL SELECT 'boolean', event_id % 5 < 3 FROM events
 UNION ALL SELECT 'labels', event_type IN ('click', 'view') FROM events UNION ALL SELECT 'per_site', event_id % 4 = 2 FROM events) GROUP BY 1"""
)
def target_contracts(spark, sf):
    """Each contract over values of which some break it."""
    k, events = F.col("event_id"), t(spark, sf, "events")
    rows = events.select(
        (F.col("value") - 10).alias("number"), F.when(k % 5 == 0, "true").when(k % 5 < 3, "false").when(k % 5 == 3, "yes").alias("flag"), "event_type",
        F.sequence(F.lit(0), (k % 4).cast("int")).alias("sites"),
    )
    each = [
        checks.target_domain(rows, "number", "non_negative").withColumn("kind", F.lit("non_negative")), checks.target_domain(rows, "flag", "boolean").withColumn("kind", F.lit("boolean")),
        checks.target_domain(rows, "event_type", "labels", ["click", "view"]).withColumn("kind", F.lit("labels")), checks.target_domain(rows, "sites", "per_site", length=F.lit(3)).withColumn("kind", F.lit("per_site")),
    ]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.select("kind", "n", "outside")


@query(
    """WITH a(leaf, i) AS (VALUES (1, 0), (5, 1), (20, 2)), b(trees, j) AS (VALUES (50, 0), (100, 1)) SELECT (i * 2 + j)::BIGINT AS position, leaf::BIGINT leaf, trees::BIGINT trees FROM a, b"""
)
def hyperparameter_grid(spark, sf):
    return lookups.grid_product(spark, {"leaf": [1, 5, 20], "trees": [50, 100]})


@query("""SELECT lang, map_entries(histogram(source)) IS NOT NULL AS held, count(DISTINCT source) sources, max(n) most FROM (SELECT lang, source, count(*) OVER (PARTITION BY lang, source) n FROM documents) GROUP BY 1""")
def source_histogram(spark, sf):
    """Counts by name as a map, and what is read from it."""
    counts = t(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).filter("source is not null")
    maps = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return maps.select("lang", F.col("by_source").isNotNull().alias("held"), F.size("by_source").cast("long").alias("sources"), F.array_max(F.map_values("by_source")).alias("most"))


@query("SELECT avg(abs(o_totalprice - 150000)) mae, count(*) n FROM orders")
def constant_baseline(spark, sf):
    rows = t(spark, sf, "orders")
    return rows.agg(M.mae(F.col("o_totalprice"), F.lit(150_000.0)).alias("mae"), F.count("*").alias("n"))
