"""Registered queries of edge products, named signals, label reports and sample rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attnlens.catalog import _K, _M, _MEANS, _SAMPLES, _SOFT, _TOK, _asym, _doc_samples, _rounded, _scores
from attnlens.operators import edges, products, report, signals
from attnlens.registry import Plan, compute
from attnlens.sources.tokens import KEY, read, sample_labels, tokens

Query = Callable[[SparkSession, str], DataFrame]
WINDOW = 5


# -- products ---------------------------------------------------------------------------------------------------------

def _vector(tok: DataFrame) -> DataFrame:
    """The first dimension of the queries."""
    return tok.select(*KEY, F.col("pos").alias("node"), F.get("q", F.lit(0)).alias("x"))


def _product(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame, DataFrame], DataFrame], normalized: bool = True) -> DataFrame:
    tok = tokens(spark, sf_dir)
    p = edges.attention(tok)
    return _rounded(of(edges.normalized(p) if normalized else p, _vector(tok)), "x")


def product_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokens(spark, sf_dir)
    return _rounded(products.scores_times(tok, _vector(tok)), "x")


def product_scores_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokens(spark, sf_dir)
    return _rounded(products.scores_times(tok, _vector(tok), transposed=True), "x")


def product_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, products.times, normalized=False)


def product_attention_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, lambda e, x: products.times(e, x, transposed=True), normalized=False)


def product_attention_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both products from one pass."""
    return _rounded(_product(spark, sf_dir, products.both_ways, normalized=False), "xt")


def product_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, products.times)


def product_m_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, lambda e, x: products.times(e, x, transposed=True))


def product_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M' (M x)."""
    return _product(spark, sf_dir, lambda e, x: products.times(e, products.times(e, x), transposed=True))


def product_antisymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, products.antisymmetric)


def product_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, products.symmetric)


def product_commutator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, products.commutator)


def _with_lse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with their row's log-sum-exp."""
    row = Window.partitionBy(*KEY, "i")
    e = edges.scores(tokens(spark, sf_dir), causal=True).withColumn("most", F.max("s").over(row))
    return e.withColumn("lse", F.col("most") + F.ln(F.sum(F.exp(F.col("s") - F.col("most"))).over(row)))


def diagonal_by_logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log weight on itself from scores and row sums alone."""
    d = _with_lse(spark, sf_dir).where("i = j").groupBy(*KEY).agg(F.avg(F.col("s") - F.col("lse")).alias("logmean"), F.max(F.exp(F.col("s") - F.col("lse"))).alias("top"))
    return _rounded(d, "logmean", "top")


def laplacian_by_logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest eigenvalues of the Laplacian without a normalized edge table."""
    w = F.exp(F.col("s") - F.col("lse"))
    d = _with_lse(spark, sf_dir).groupBy(*KEY, "j").agg(F.sum(F.when(F.col("i") != F.col("j"), w).otherwise(0.0)).alias("v"))
    return _rounded(d.groupBy(*KEY).agg(F.slice(F.sort_array(F.collect_list("v"), False), 1, 10).alias("eigvals")), "eigvals")


# -- named signals ----------------------------------------------------------------------------------------------------

def routing_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(tokens(spark, sf_dir), Plan("routing"))


def tracker_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(tokens(spark, sf_dir), Plan("tracker"))


def routing_curl_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curl part over the antisymmetric part, of two asked heads."""
    return _rounded(compute(tokens(spark, sf_dir), Plan("routing", heads=frozenset((1, 7)))).select(*KEY, "g", "curl_ratio", "commutator_norm"), "g", "curl_ratio", "commutator_norm")


def asymmetry_local_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each disjoint window by itself."""
    found = compute(tokens(spark, sf_dir), Plan("asymmetry", window=WINDOW, tumbling=True, length=20))
    return _rounded(found.select(*KEY, "window_id", "g", "gamma", "c"), "g", "gamma", "c")


def cyclic_local_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(tokens(spark, sf_dir), Plan("cyclic", window=WINDOW, tumbling=True, length=20)).select(*KEY, "window_id", "t_cyc")


# -- reports ----------------------------------------------------------------------------------------------------------

def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of each layer, long, with the sample's label; rounded first, so that ties are the same in both engines."""
    d = signals.diagonal(edges.attention(tokens(spark, sf_dir)), 2)
    m = d.groupBy("request_id", "layer_idx").agg(F.round(F.avg("logmean"), 9).alias("ad_logmean"), F.round(F.avg(F.get("eigvals", F.lit(1))), 9).alias("ad_second"))
    long = m.unpivot(["request_id", "layer_idx"], ["ad_logmean", "ad_second"], "feature", "x")
    return long.join(sample_labels(spark, sf_dir), "request_id")


def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and AUROC of every layer, and of all layers' mean."""
    return _rounded(report.signal_report(_features(spark, sf_dir), "request_id", "layer_idx", "feature", "x", "label"), "r", "auroc")


def best_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.signal_report(_features(spark, sf_dir), "request_id", "layer_idx", "feature", "x", "label")
    return _rounded(report.best_layers(found, "feature"), "r", "auroc")


def point_biserial_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with their two-sided p."""
    found = report.signal_report(_features(spark, sf_dir), "request_id", "layer_idx", "feature", "x", "label")
    return found.select("feature", "layer", "n", "r", report.p_value("r", "n").alias("p"))


def length_whiskers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.whiskers(_doc_samples(spark, sf_dir), ["label"], "length"), "q1", "q2", "q3", "low", "high")


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label by source, and whether there are enough of both."""
    return report.class_counts(_doc_samples(spark, sf_dir), ["prompt"], "label")


def length_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of the length by source."""
    return _rounded(report.value_auroc(_doc_samples(spark, sf_dir), ["prompt"], "length", "label"), "auroc")


def median_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and peak value of each event type."""
    return _rounded(read(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("peak")), "median", "peak")


def found_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that have any value, in their order."""
    return _features(spark, sf_dir).where("x is not null").groupBy("feature").agg(F.countDistinct("request_id").alias("samples"), F.countDistinct("layer_idx").alias("layers")).orderBy("feature")


# -- sample rules -----------------------------------------------------------------------------------------------------

def either_flag_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic or of low quality, without one source; the label by its name."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").where(F.col("source").isNull() | (F.col("source") != "web"))
    label = ((F.col("toxic") > 0) | (F.col("quality") == 0)).cast("int")
    return rows.select("doc_id", label.alias("label"), F.when(label == 0, "Correct").otherwise("Hallucinated").alias("name"))


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels given as texts."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "TRUE").when(F.col("turn") % 2 == 0, "1").otherwise("no").alias("given"))
    return rows.select("conv_id", "turn", F.lower("given").isin("1", "true", "injection").cast("int").alias("label"))


def features_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature row with its sample's length where there is one."""
    # a request without a document of its number has no sample
    lengths = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"), F.lit(1).alias("sampled")).distinct().join(
        tokens(spark, sf_dir).groupBy("request_id").agg((F.max("pos") + 1).alias("length")), "request_id").drop("sampled")
    return _rounded(_features(spark, sf_dir).join(lengths, "request_id", "left"), "x")


# -- DuckDB SQL -------------------------------------------------------------------------------------------------------

_X = f"x as (select {_K}, pos node, q[1] x from tok)"


def _times(ctes: str, source: str, transposed: bool = False) -> str:
    near, far = ("j", "i") if transposed else ("i", "j")
    return f"""{ctes.replace("x as (select *, exp", "xx as (select *, exp").replace("from x)", "from xx)")}, {_X}
select {_K}, {near} node, round(sum(p * x), 6) + 0.0 x from {source} join (select {_K}, node {far}, x from x) using ({_K}, {far}) group by {_K}, {near}"""


def _dense(combine: str) -> str:
    """Sums over all pairs of tokens, with ``a`` the entry (i, j) and ``b`` the entry (j, i)."""
    return f"""{_M.replace("x as (select *, exp", "xx as (select *, exp").replace("from x)", "from xx)")}, {_X},
f as (select {_K}, a.pos i, b.pos j, coalesce(m.p, 0) p from tok a join tok b using ({_K})
  left join m on (m.request_id, m.layer_idx, m.head, m.i, m.j) = (a.request_id, a.layer_idx, a.head, a.pos, b.pos)),
y as (select {_K}, f.i, sum(p * x) y from f join (select {_K}, node j, x from x) using ({_K}, j) group by {_K}, f.i),
z as (select {_K}, f.j, sum(p * x) z from f join (select {_K}, node i, x from x) using ({_K}, i) group by {_K}, f.j)
{combine}"""


_CORR = "count(*) n, case when count(*) >= 10 and count(distinct label) = 2 then corr(label::double, x) end r"
_REPORT = f"""{_SOFT}, d as (select {_K}, avg(ln(p + 1e-10)) logmean, list(p order by p desc)[2] top from p where i = j group by {_K}),
l as (select vec_id // 20 request_id, (sum(label) % 2)::int as label from embeddings group by 1),
g as (select request_id, layer_idx, round(avg(logmean), 9) a, round(avg(top), 9) b from d group by request_id, layer_idx),
f as (select request_id, layer_idx, unnest(['ad_logmean', 'ad_second']) feature, unnest([a, b]) x from g),
fl as (select * from f join l using (request_id)),
al as (select request_id, feature, layer_idx::varchar layer, x, label from fl
  union all select request_id, feature, 'ALL', round(avg(x), 9), any_value(label) from fl group by request_id, feature),
k as (select *, rank() over (partition by feature, layer order by x) + (count(*) over (partition by feature, layer, x) - 1) / 2 k from al),
u as (select feature, layer, case when count(*) >= 10 and sum(label) > 0 and sum(1 - label) > 0
  then (sum(case when label = 1 then k end) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) else 0.5 end auroc from k group by feature, layer),
r as (select feature, layer, {_CORR} from al group by feature, layer),
rep as (select feature, layer, n, r, auroc from r join u using (feature, layer))"""
_LOCAL = f"""with {_TOK}e as (select a.request_id, a.layer_idx, a.head, a.pos // 5 w, a.pos i, b.pos j, list_dot_product(a.q, b.k) / sqrt(8.0) s
  from tok a join tok b using ({_K}) where b.pos <= a.pos and b.pos // 5 = a.pos // 5),
x as (select *, exp(s - max(s) over (partition by {_K}, i)) v from e), p as (select {_K}, w, i, j, v / sum(v) over (partition by {_K}, i) p from x),
t as (select {_K}, w, sum(p * p) sq, sum(case when i = j then p * p else 0 end) sym from p group by {_K}, w),
r as (select {_K}, w, node, sum(v) r from (select {_K}, w, i node, p / 2 v from p union all select {_K}, w, j, -p / 2 from p) group by {_K}, w, node),
rr as (select {_K}, w, sum(r * r) * 2 / 5 g2 from r group by {_K}, w)
select {_K}, w window_id, round(sqrt((sq - sym) / 2 / sq), 6) g, round(sqrt(g2 / sq), 6) gamma, round(sqrt(greatest((sq - sym) / 2 - g2, 0) / sq), 6) c from t join rr using ({_K}, w)"""
_LSE = f"with {_TOK}{_scores(True).rstrip().rstrip(',')}, o as (select *, max(s) over (partition by {_K}, i) m from e), z as (select *, m + ln(sum(exp(s - m)) over (partition by {_K}, i)) lse from o)"

ORACLES: dict[str, str] = {
    "product_scores": f"with {_TOK}{_X} select {_K}, a.pos node, round(sum(list_dot_product(a.q, b.k) * x), 6) + 0.0 x from tok a join tok b using ({_K}) join (select {_K}, node, x from x) c using ({_K}) where c.node = b.pos group by {_K}, a.pos",
    "product_scores_transposed": f"with {_TOK}{_X} select {_K}, a.pos node, round(sum(list_dot_product(b.q, a.k) * x), 6) + 0.0 x from tok a join tok b using ({_K}) join (select {_K}, node, x from x) c using ({_K}) where c.node = b.pos group by {_K}, a.pos",
    "product_attention": _times(_SOFT, "p"), "product_attention_transposed": _times(_SOFT, "p", True),
    "product_attention_both": f"with a as ({_times(_SOFT, 'p')}), b as ({_times(_SOFT, 'p', True)}) select {_K}, node, a.x, b.x xt from a join b using ({_K}, node)",
    "product_m": _times(_M, "m"), "product_m_transposed": _times(_M, "m", True),
    "product_gram": _dense(f"select {_K}, f.j node, round(sum(p * y), 6) + 0.0 x from f join y using ({_K}, i) group by {_K}, f.j"),
    "product_antisymmetric": _dense(f"select {_K}, y.i node, round((y - z) / 2, 6) + 0.0 x from y join (select {_K}, j i, z from z) using ({_K}, i)"),
    "product_symmetric": _dense(f"select {_K}, y.i node, round((y + z) / 2, 6) + 0.0 x from y join (select {_K}, j i, z from z) using ({_K}, i)"),
    "product_commutator": _dense(f"""select {_K}, node, round(sum(v) / 2, 6) + 0.0 x from (select {_K}, f.j node, p * y v from f join y using ({_K}, i)
  union all select {_K}, f.i, -p * z from f join z using ({_K}, j)) group by {_K}, node"""),
    "diagonal_by_logsumexp": f"{_LSE} select {_K}, round(avg(s - lse), 6) logmean, round(max(exp(s - lse)), 6) top from z where i = j group by {_K}",
    "laplacian_by_logsumexp": f"{_LSE} select {_K}, list_transform(list(v order by v desc)[1:10], lambda x: round(x, 6) + 0.0) eigvals from (select {_K}, j, sum(case when i <> j then exp(s - lse) else 0 end) v from z group by {_K}, j) group by {_K}",
    "asymmetry_local_windows": _LOCAL,
    "cyclic_local_windows": f"""with {_TOK}e as (select a.request_id, a.layer_idx, a.head, a.pos // 5 w, a.pos i, b.pos j, list_dot_product(a.q, b.k) s from tok a join tok b using ({_K}) where b.pos // 5 = a.pos // 5),
b as (select {_K}, w, e.i from e join (select {_K}, w, j i, i j, s t from e) f using ({_K}, w, i, j) where e.i <> e.j and (s > t or (s = t and e.i < e.j))),
c as (select {_K}, w, i, count(*) c from b group by {_K}, w, i) select {_K}, w window_id, (10 - sum(c * (c - 1) // 2))::bigint t_cyc from c group by {_K}, w""",
    "signal_report": f"{_REPORT} select feature, layer, n, round(r, 6) + 0.0 r, round(auroc, 6) + 0.0 auroc from rep",
    "best_layers": f"""{_REPORT}, a as (select *, row_number() over (partition by feature order by round(abs(coalesce(r, 0)), 9) desc, layer::int) o from rep where layer <> 'ALL'),
b as (select *, row_number() over (partition by feature order by round(abs(auroc - 0.5), 9) desc, layer::int) o from rep where layer <> 'ALL')
select feature, a.layer layer_by_r, round(a.r, 6) + 0.0 r, b.layer layer_by_auroc, round(b.auroc, 6) + 0.0 auroc from a join b using (feature) where a.o = 1 and b.o = 1""",
    "length_whiskers": f"""{_SAMPLES}, q as (select label, quantile_cont(length, 0.25) a, quantile_cont(length, 0.5) b, quantile_cont(length, 0.75) c, min(length) l, max(length) h from s group by label)
select label, round(a, 6) q1, round(b, 6) q2, round(c, 6) q3, round(greatest(l, a - 1.5 * (c - a)), 6) low, round(least(h, c + 1.5 * (c - a)), 6) high from q""",
    "class_counts": f"{_SAMPLES} select prompt, count(label) n, sum(label)::bigint positive, count(distinct label)::int classes, (count(label) - sum(label))::bigint negative, least(sum(label), count(label) - sum(label)) >= 3 enough from s group by prompt",
    "length_auroc": f"""{_SAMPLES}, k as (select *, rank() over (partition by prompt order by length) + (count(*) over (partition by prompt, length) - 1) / 2 k from s where length is not null)
select prompt, count(*) n, round(case when count(*) >= 10 and sum(label) > 0 and sum(1 - label) > 0 then (sum(case when label = 1 then k end) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) else 0.5 end, 6) auroc from k group by prompt""",
    "median_values": "select event_type, round(quantile_cont(value, 0.5), 6) + 0.0 median, round(max(value), 6) + 0.0 peak from events group by event_type",
    "found_features": f"{_REPORT} select feature, count(distinct request_id) samples, count(distinct layer_idx) layers from fl where x is not null group by feature",
    "either_flag_label": "select doc_id, (toxic > 0 or quality = 0)::int as label, case when toxic > 0 or quality = 0 then 'Hallucinated' else 'Correct' end as name from documents join labels using (doc_id) where source is null or source <> 'web'",
    "text_labels": "select conv_id, turn, (lower(case when role = 'user' then 'TRUE' when turn % 2 = 0 then '1' else 'no' end) in ('1', 'true', 'injection'))::int as label from conversations",
    "features_with_samples": f"{_REPORT}, n as (select request_id, max(pos) + 1 length from tok where request_id in (select doc_id from labels) group by request_id) select request_id, layer_idx, feature, round(x, 6) + 0.0 x, label, length from fl left join n using (request_id)",
}

def _curl_ratio() -> str:
    """The split's energies, their ratio, and the commutator's norm, of two heads."""
    from attnlens.more import _commutator

    split = _M + _asym("m")
    energies = f"{split[: split.rindex('select')]}select {_K}, (sq - sym) / 2 / sq g2, greatest((sq - sym) / 2 - 2 * rr / n, 0) / sq c2 from t join rr using ({_K})"
    return f"""with a as ({energies}), b as ({_commutator(_M, "m")})
select {_K}, round(sqrt(greatest(g2, 0)), 6) g, round(case when g2 > 1e-20 then sqrt(c2 / g2) else 0 end, 6) curl_ratio, commutator_norm from a join b using ({_K}) where head in (1, 7)"""


ORACLES["routing_curl_ratio"] = _curl_ratio()

QUERIES: list[Query] = [
    product_scores, product_scores_transposed, product_attention, product_attention_transposed, product_attention_both, product_m, product_m_transposed, product_gram,
    product_antisymmetric, product_symmetric, product_commutator, diagonal_by_logsumexp, laplacian_by_logsumexp, routing_signal, tracker_signal, routing_curl_ratio,
    asymmetry_local_windows, cyclic_local_windows, signal_report, best_layers, point_biserial_p, length_whiskers, class_counts, length_auroc, median_values,
    found_features, either_flag_label, text_labels, features_with_samples]
