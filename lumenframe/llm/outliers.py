"""Quality rules from text statistics, and robust multivariate outliers among them. DataFrame functions only.

The statistics of every document are counted with array functions inside its row, so no text is exploded or
shuffled. Documents that pass the base rules are judged by the minimum covariance determinant: for each language and
source, the centre and scatter of the tightest three quarters of its documents are found by concentration steps
(distances, their quantile, moments of the nearer ones), all as grouped sums that are added up before the shuffle.
Scatter is floored by a diagonal, so a statistic that is nearly constant in a group doesn't make every other value an
outlier. A group of fewer than ``MIN_GROUP`` documents, too few for estimates of four dimensions, takes those of its
language, and of the whole table only if the language has fewer, too.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; rows without an id are left out; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.scratch import kept

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of a group that its estimates describe, number of concentration steps, and the smallest group with its own:
#: ten documents for each of the four statistics.
INNER, STEPS, MIN_GROUP = 0.75, 3, 40
#: Median of the chi-squared distribution with four degrees of freedom, and the squared distance that rejects.
CHI2_MEDIAN, CUTOFF = 3.3567, 45.0
#: What is added to the variance of each statistic.
FLOOR = (0.06**2, 0.35**2, 0.35**2, 0.35**2)
N = len(FLOOR)
#: Parts into which the rows of a group are dealt where they meet its estimates.
SALTS = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words in three-word windows that the array holds twice or more."""

    def marked(pairs: Column) -> Column:
        hit = lambda e, j: (F.get(pairs, j - 1)["h"] == e["h"]) | (F.get(pairs, j + 1)["h"] == e["h"])
        return F.sort_array(F.array_compact(F.transform(pairs, lambda e, j: F.when(hit(e, j), e["i"]))))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(p - F.get(at, j - 1), F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, lambda p: _let(marked(p), covered)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows, of))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = lambda c: F.length(c).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    dense = F.translate(text, SPACES, "")
    counts = _let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")),
    )
    return docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", counts.alias("c"),
        length(dense).alias("word_chars"), (length(dense) - length(F.translate(dense, SYMBOLS, ""))).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """The transformed statistics: logarithms of word length and of shares, each with a small constant."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log(F.col("n_symbols") / n + 0.02),
        F.log(F.col("n_dup_lines") / n + 0.02), F.log(F.col("n_repeat_words") / n + 0.05),
    ]


def _factored(est: DataFrame) -> DataFrame:
    """``grp, n, m0..`` and the lower Cholesky factor ``l00, l10, ..`` of the floored scatter ``c00, c10, ..``."""
    for j in range(N):
        done = lambda i: reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))  # noqa: E731, B023
        est = est.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") + F.lit(FLOOR[j]) - done(j), F.lit(FLOOR[j]))))
        est = est.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - done(i)) / F.col(f"l{j}{j}") for i in range(j + 1, N)})
    return est.select("grp", "n", *[f"m{i}" for i in range(N)], *[f"l{i}{j}" for i in range(N) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance of ``f0..`` by forward substitution; each step is worked out once."""

    def step(i: int, done: list[Column]) -> Column:
        if i == N:
            return reduce(lambda a, b: a + b, [y * y for y in done])
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * done[k] for k in range(i)], F.col(f"f{i}") - F.col(f"m{i}"))
        return _let(rest / F.col(f"l{i}{i}"), lambda y: step(i + 1, [*done, y]))

    return step(0, [])


def _beside(rows: DataFrame, groups: DataFrame, key: str = "grp", how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group, over ``SALTS`` copies of it: a group may hold most of the rows."""
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, [key, "salt"], how)


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")


def estimates(rows: DataFrame) -> DataFrame:
    """Centre, scatter factor and scale of each ``grp`` of ``grp, salt, f0..`` rows."""
    cols = [f"f{i}" for i in range(N)]
    quantile = lambda c, q: F.percentile_approx(c, q, 2000)
    middle = rows.groupBy("grp").agg(F.count("*").alias("n"), *[quantile(c, 0.5).alias(f"m{i}") for i, c in enumerate(cols)])
    around = _beside(rows, middle).groupBy("grp").agg(
        F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(N)],
        *[F.pow(1.4826 * quantile(F.abs(F.col(f"f{i}") - F.col(f"m{i}")), 0.5), F.lit(2)).alias(f"c{i}{i}") for i in range(N)],
    )
    est = kept(_factored(around.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(N) for j in range(i)})), "mcd-start")
    for step in range(STEPS):
        at = _beside(rows, est).withColumn("d", _distance())
        nearest = at.groupBy("grp").agg(quantile(F.col("d"), INNER).alias("cut"))
        inner = _beside(at, nearest).filter(F.col("d") <= F.col("cut"))
        # moments about the last centre keep the sums small
        off = [F.col(f"f{i}") - F.col(f"m{i}") for i in range(N)]
        sums = inner.groupBy("grp").agg(
            F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"o{i}") for i in range(N)], *[F.avg(off[i]).alias(f"s{i}") for i in range(N)],
            *[F.avg(off[i] * off[j]).alias(f"q{i}{j}") for i in range(N) for j in range(i + 1)],
        )
        moved = sums.select(
            "grp", "n", *[(F.col(f"o{i}") + F.col(f"s{i}")).alias(f"m{i}") for i in range(N)],
            *[(F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i in range(N) for j in range(i + 1)],
        )
        est = kept(_factored(moved), f"mcd-{step}")
    scale = _beside(rows, est).groupBy("grp").agg((quantile(_distance(), 0.5) / CHI2_MEDIAN).alias("raw"))
    return kept(est.join(scale.select("grp", F.greatest("raw", F.lit(1.0)).alias("scale")), "grp"), "mcd")


def _chosen(rows: DataFrame) -> DataFrame:
    """``own, grp``: the group whose estimates judge the documents of each ``own``; ``*`` is the whole table."""
    sizes = rows.groupBy("wide", "own").agg(F.count("*").alias("size"))
    wide = sizes.groupBy("wide").agg(F.sum("size").alias("wide_size"))
    grp = F.when(F.col("size") >= MIN_GROUP, F.col("own")).when(F.col("wide_size") >= MIN_GROUP, F.concat(F.lit("lang "), F.col("wide"))).otherwise("*")
    return sizes.join(wide, "wide").select("own", grp.alias("grp"))


def _levels(rows: DataFrame) -> DataFrame:
    """``grp, salt, f0..``: every row once for each group that it is part of."""
    grp = F.explode(F.array(F.col("own"), F.concat(F.lit("lang "), F.col("wide")), F.lit("*")))
    return rows.select(grp.alias("grp"), "salt", *[f"f{i}" for i in range(N)])


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, ``distance`` (squared, null where the base rules fail) and ``kept`` of every document."""
    stats = kept(statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    # "=": a value, "-": null; the language's group has no tab
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    own = F.concat(lang, F.lit("\t"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    rows = stats.filter(~F.col("base_failed")).select("doc_id", _salt(), lang.alias("wide"), own.alias("own"), *[f.alias(f"f{i}") for i, f in enumerate(features())])
    est = estimates(_levels(rows))
    named = _chosen(rows).join(est, "grp").drop("grp", "n")
    keyed = _beside(stats.withColumns({"own": own, "salt": _salt()}), named, "own", "left").withColumns({f"f{i}": f for i, f in enumerate(features())})
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    return keyed.select(*stats.columns, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))
