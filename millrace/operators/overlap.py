"""N-gram overlap of predictions with references, over a corpus: the two lexical parts of a code score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts for a match that is not there, so that one missing length of n-grams does not make a score 0.
EPSILON = 0.1


def overlaps(pairs: DataFrame, longest: int = 4, keywords: list[str] | None = None, other_weight: float = 0.2) -> DataFrame:
    """n, matched, predicted and expected: n-grams of each length over all pairs (id, reference, prediction).

    A text's tokens are what white space parts; null texts have none. Of each
    n-gram of a pair as many match as both sides have; rows of equal ids are
    pairs of their own. ``predicted`` and ``expected`` count a pair without such
    an n-gram as one. With ``keywords`` single tokens count as ``other_weight``
    unless they are keywords. A pair's n-grams never meet those of another, so
    they are counted where the row is. Texts are dealt evenly once, since a small
    file may be one part; of the n-grams only a batch's sums are shuffled.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = pairs.select("reference", "prediction").repartition(n).select(_tokens("reference").alias("r"), _tokens("prediction").alias("p"))
    weigh = None if keywords is None else (frozenset(keywords), other_weight)
    per = rows.mapInArrow(_counted(longest, weigh), "n int, matched double, predicted double, expected double")
    return per.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matched", "predicted", "expected")])


def _tokens(c: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda t: t != "")


def _counted(longest: int, weigh: tuple[frozenset[str], float] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each length and batch of token lists (r, p): sums of matched, predicted and expected n-grams."""

    def weight(n: int, gram: tuple[str, ...]) -> float:
        return weigh[1] if weigh and n == 1 and gram[0] not in weigh[0] else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [[0.0, 0.0, 0.0] for _ in range(longest)]
            for r, p in zip(b.column(0), b.column(1), strict=True):
                r, p = r.as_py(), p.as_py()
                for n, out in enumerate(sums, 1):
                    expected, predicted = (Counter(zip(*[side[i:] for i in range(n)], strict=False)) for side in (r, p))
                    met = expected & predicted
                    total = lambda c: float(c.total()) if n > 1 or not weigh else sum(k * weight(n, g) for g, k in c.items())  # noqa: B023, E731
                    out[0] += total(met)
                    out[1] += max(total(predicted), 1.0)
                    out[2] += max(total(expected), 1.0)
            yield pa.RecordBatch.from_pydict({"n": pa.array(range(1, longest + 1), pa.int32()), **{c: pa.array([x[i] for x in sums]) for i, c in enumerate(("matched", "predicted", "expected"))}})

    return run


def lengths(pairs: DataFrame) -> DataFrame:
    """The numbers of tokens of all references and predictions."""
    count = lambda c: F.coalesce(F.sum(F.size(_tokens(c))), F.lit(0))
    return pairs.agg(count("reference").alias("reference"), count("prediction").alias("prediction"))


def ngram_scores(pairs: DataFrame, keywords: list[str], longest: int = 4) -> DataFrame:
    """ngram_match and weighted_ngram_match of a corpus of pairs (id, reference, prediction), one row.

    The first is the geometric mean over lengths of matched by predicted
    n-grams, the second of matched by expected ones with keywords weighted; both
    times the brevity penalty. A length without a match counts EPSILON; without a
    single common token a score is 0.
    """

    def mean(counts: DataFrame, of: str, name: str) -> DataFrame:
        share = F.when(F.col("matched") > 0, F.col("matched")).otherwise(EPSILON) / F.col(of)
        return counts.agg(F.when(F.max(F.when((F.col("n") == 1) & (F.col("matched") > 0), 1)) == 1, F.exp(F.avg(F.log(share)))).otherwise(0.0).alias(name))

    size = lengths(pairs)
    penalty = F.when(F.col("prediction") == 0, 0.0).when(F.col("prediction") > F.col("reference"), 1.0).otherwise(F.exp(1 - F.col("reference") / F.col("prediction")))
    plain, weighted = mean(overlaps(pairs, longest), "predicted", "a"), mean(overlaps(pairs, longest, keywords), "expected", "b")
    one = size.join(F.broadcast(plain), F.lit(True)).join(F.broadcast(weighted), F.lit(True))  # a row each
    return one.select((penalty * F.col("a")).alias("ngram_match_score"), (penalty * F.col("b")).alias("weighted_ngram_match_score"))
