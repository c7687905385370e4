"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule is a rate of a text in per mille.  Fixed base rules reject first.  For
the rest, labelled rows are a holdout: in every stratum and for every rule and
candidate cutoff, the good rows that the cutoff would reject are counted, and
the cutoff is admitted if the exact binomial test shows a false rejection rate
below the rule's share of the allowed risk: P(Binomial(n, risk) <= rejected) is
at most the error level divided by the number of all tests (Bonferroni).  The
lowest admitted cutoff counts; a rule with none rejects nothing there.

The bound holds for the good rows that pass the base rules, as the base is fixed; how
many good rows of a stratum the base rejects is returned beside the cutoffs.

Defined results: null text has no words (and fails the base); a null stratum is
a stratum of its own, apart from the empty one; labels without a document and
documents without a label are no evidence; repeated labels of a document count
once (as bad if one of them is), and so do its repeated rows, as the bound needs
independent rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Highest share of good rows of a stratum that the rules together may reject, and the chance that any bound is wrong.
RISK, ERROR = 0.02, 0.05
#: Candidate cutoffs of each rule, in per mille: a text is rejected above its cutoff.
CUTOFFS = {
    "symbols": (20, 30, 50, 80, 120, 200, 300, 500),
    "dup_lines": (50, 100, 150, 200, 300, 400, 500, 700),
    "repeats": (50, 80, 120, 160, 200, 240, 280),
    "long_words": (8000, 10000, 12000, 15000, 20000, 30000, 50000),
}
#: Thresholds that may be sent to every executor; beyond, they are joined by stratum.
BROADCAST_STRATA = 100_000


def _repeat_words() -> Column:
    """Words covered by windows that occur twice or more; reads the columns __words, __h and, where some repeat, __s."""
    at = lambda k: F.get("__s", k)
    same = lambda a, b: a["h"] == b["h"]
    last = F.size("__s") - 1
    twice = lambda k: F.coalesce(same(at(k), at(k - 1)), F.lit(False)) | F.coalesce(same(at(k), at(k + 1)), F.lit(False))
    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twice), lambda k: at(k)["i"]))
    state = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    joined = F.aggregate(
        places,
        state,
        lambda a, p: F.struct((a["words"] + F.least(F.lit(WINDOW), p - a["last"])).alias("words"), p.alias("last")),
        lambda a: a["words"],
    )
    return F.when(F.col("__s").isNull(), 0).otherwise(joined).cast("long")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    rows = rows.withColumns(
        {
            "__words": F.array_remove(F.split("__text", SPACES + "+"), ""),
            "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))
    rows = rows.withColumn("__h", F.when(F.size("__words") > WINDOW, windows))
    ordered = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), ordered))
    return rows.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )


def rates() -> dict[str, Column]:
    """The rules' rates, floored to whole per mille; null where there is nothing to divide by."""
    part = lambda a, b: F.expr(f"({a} * 1000) div nullif({b}, 0)")
    return {
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "long_words": part("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 16, stepped back to x: exact to some 1e-13."""
    y = x + 16.0
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    for j in range(16):
        series = series - F.ln(x + float(j))
    return series


def tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k below n * p, where the terms fall on the way down; 1 from there on.

    The sum stops after 60 standard deviations, where terms are below the precision of a double."""
    one = F.lit(1.0)
    head = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(60 * F.sqrt(n)) + 60).cast("int")
    state = F.struct(one.alias("term"), one.alias("sum"))

    def step(a: Column, j: Column) -> Column:
        i = k - j + 1
        term = a["term"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), state, step, lambda a: a["sum"])
    return F.when(k >= n * p, one).otherwise(F.exp(head) * total)


def thresholds(stats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum with good holdout rows: __stratum, n_good, n_base (of these, rejected by the base), and the admitted cutoff of each rule or null.

    stats must be written out (materialise): every cutoff reads its columns."""
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc")).agg(F.min("quality").alias("__good")).filter("__good = 1")
    known = stats.join(good, F.col("doc_id") == F.col("__doc")).drop("__doc", "__good").dropDuplicates()
    names = [(rule, cut) for rule, cuts in CUTOFFS.items() for cut in cuts]
    of, passed = rates(), ~base_failed()
    counts = known.groupBy(F.col(stratum).alias("__stratum")).agg(
        F.count(F.lit(1)).alias("n_good"),
        F.sum(F.when(passed, 1.0).otherwise(0.0)).alias("n"),
        *[F.sum(F.when(passed & (of[rule] > cut), 1.0).otherwise(0.0)).alias(f"{rule}_{cut}") for rule, cut in names],
    )
    tests = counts.filter("n > 0").agg(F.count(F.lit(1)).alias("__strata"))
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cut"), F.col(f"{rule}_{cut}").alias("k")) for rule, cut in names])
    wide = counts.select("__stratum", "n_good", "n", F.explode(each).alias("t")).join(F.broadcast(tests))
    level = error / len(names) / F.col("__strata")
    admitted = (F.col("n") > 0) & (tail(F.col("n"), F.col("t.k"), risk / len(CUTOFFS)) <= level)
    cuts = [F.min(F.when(admitted & (F.col("t.rule") == rule), F.col("t.cut"))).alias(f"__cut_{rule}") for rule in CUTOFFS]
    return wide.groupBy("__stratum").agg(F.first("n_good").alias("n_good"), F.first(F.col("n_good") - F.col("n")).cast("long").alias("n_base"), *cuts)


def verdicts(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """stats with base_failed, kept and one boolean reject_<rule> for each rule."""
    cutoffs = materialise(cutoffs.drop("n_good", "n_base"))
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    rows = stats.join(cutoffs, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    of = rates()
    rejects = {rule: F.coalesce(of[rule] > F.col(f"__cut_{rule}"), F.lit(False)) for rule in CUTOFFS}
    kept = ~base_failed()
    for x in rejects.values():
        kept = kept & ~x
    return rows.select(*[stats[c] for c in stats.columns], base_failed().alias("base_failed"), kept.alias("kept"), *[x.alias(f"reject_{rule}") for rule, x in rejects.items()])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(statistics(read(spark, sf_dir, "documents"), keep=("doc_id", "lang")))
    found = verdicts(stats, thresholds(stats, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The risk of the query below: high enough that the holdout of small tables admits cutoffs.
HIGH_RISK = 0.2


def quality_rules_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules under a risk that small holdouts can prove: what each rule rejects."""
    stats = materialise(statistics(read(spark, sf_dir, "documents"), keep=("doc_id", "lang")))
    found = verdicts(stats, thresholds(stats, read(spark, sf_dir, "labels"), risk=HIGH_RISK))
    return found.select("doc_id", "base_failed", "kept", *[f"reject_{rule}" for rule in CUTOFFS])


def _oracle(risk: float = RISK, detail: bool = False) -> str:
    word = r"[^\x20\x09-\x0D]+"
    tests = ", ".join(f"('{rule}', {cut})" for rule, cuts in CUTOFFS.items() for cut in cuts)
    n_tests = sum(map(len, CUTOFFS.values()))
    p = risk / len(CUTOFFS)
    if detail:
        last = ", ".join(f"coalesce(list_contains(o.rules, '{rule}'), false) AS reject_{rule}" for rule in CUTOFFS)
        columns = f"b.doc_id, base_failed, NOT base_failed AND o.rules IS NULL AS kept, {last}"
    else:
        columns = "b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.rules IS NULL AS kept"
    return f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM documents
), h AS (
  SELECT doc_id, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})
), again AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, {WINDOW}) r(j) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, w.lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
r AS (
  SELECT *, (n_symbols * 1000) // nullif(word_chars, 0) AS symbols, (n_dup_lines * 1000) // nullif(n_lines, 0) AS dup_lines,
    (n_repeat_words * 1000) // nullif(n_words, 0) AS repeats, (word_chars * 1000) // nullif(n_words, 0) AS long_words FROM b
), tests(rule, cut) AS (VALUES {tests}),
long AS (UNPIVOT (SELECT doc_id, lang IS NULL AS unnamed, coalesce(lang, '') AS stratum, symbols, dup_lines, repeats, long_words FROM r) ON symbols, dup_lines, repeats, long_words INTO NAME rule VALUE rate),
marks AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT r.doc_id, lang IS NULL AS unnamed, coalesce(lang, '') AS stratum FROM r JOIN marks USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT unnamed, stratum, count(*) AS n FROM good GROUP BY ALL),
rejected AS (
  SELECT z.unnamed, z.stratum, z.n, t.rule, t.cut,
    (SELECT count(*) FROM good g JOIN long x ON x.doc_id = g.doc_id WHERE g.unnamed = z.unnamed AND g.stratum = z.stratum AND x.rule = t.rule AND x.rate > t.cut) AS k
  FROM sizes z CROSS JOIN tests t
), bound AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM range(0, k + 1) q(i)) AS tail FROM rejected
), cuts AS (SELECT unnamed, stratum, rule, min(cut) AS cut FROM bound WHERE k < n * {p} AND tail <= {ERROR} / {n_tests} / (SELECT count(*) FROM sizes) GROUP BY ALL),
out_ AS (SELECT x.doc_id, list(x.rule) AS rules FROM long x JOIN cuts c ON x.unnamed = c.unnamed AND x.stratum = c.stratum AND x.rule = c.rule AND x.rate > c.cut GROUP BY x.doc_id)
SELECT {columns} FROM b LEFT JOIN out_ o ON b.doc_id = o.doc_id
"""


ORACLE = _oracle()
HIGH_RISK_ORACLE = _oracle(HIGH_RISK, detail=True)
