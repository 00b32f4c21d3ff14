"""did-you-mean suggestions for file names."""

from __future__ import annotations

import difflib
import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import shuffle_width

# Least similarity, suggestions per lookup.
MIN_RATIO = 0.6
SUGGESTIONS = 5


def _bound(letters: Counter, size: int, other: Counter, other_size: int) -> float:
    """No less than the similarity of two texts: they share at most the letters that both have (``quick_ratio``)."""
    total = size + other_size
    return 2.0 * sum(min(n, other.get(ch, 0)) for ch, n in letters.items()) / total if total else 1.0


class _Scorer:
    """Scores the names of one task. A name is compared in full only while it can still be among the best of a target: the
    distinct names seen before it stand for at least one path each, so what is below the last of ``top`` of them is out."""

    def __init__(self, targets: list[str], top: int):
        self.targets = [(t, Counter(t), len(t)) for t in targets]
        self.top = max(top, 1)
        self.best: dict[str, list[float]] = {t: [] for t in targets}

    def scores(self, name: str) -> list[dict]:
        found, matcher = [], None
        letters = Counter(name)
        for target, own, size in self.targets:
            best = self.best[target]
            bound = _bound(own, size, letters, len(name))
            if (len(best) == self.top and bound < best[0]) or (bound < MIN_RATIO and target not in name):
                continue
            if matcher is None:
                # The candidate is the second sequence of the comparison; its index is built once per name.
                matcher = difflib.SequenceMatcher(None, "", name)
            matcher.set_seq1(target)
            ratio = matcher.ratio()
            if target in name or ratio >= MIN_RATIO:
                found.append({"target": target, "ratio": ratio})
                (heapq.heappushpop if len(best) == self.top else heapq.heappush)(best, ratio)
        return found


def did_you_mean(catalog: DataFrame, targets: list[str], path: str = "path", top: int = SUGGESTIONS) -> DataFrame:
    """Best catalogue paths per target: the target is part of the name, or similarity is high enough.

    The request's targets travel with the function; the catalogue is scanned once, and each distinct name is scored once, in
    tasks whose number does not depend on the files of the catalogue. Only matches that can be among the ``top`` leave them.
    """
    wanted = sorted({t.lower() for t in targets})

    # What a task has seen decides which hits it still reports. So no filter on hits may be made of it and run before the shuffle.
    @F.pandas_udf("array<struct<target:string,ratio:double>>")
    def score(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(wanted, top)
        for batch in names:
            yield batch.map(scorer.scores)

    score = score.asNondeterministic()
    name = F.lower(F.substring_index(F.col(path), "/", -1))
    rows = catalog.select(F.col(path).alias("path"), name.alias("name"))
    # Names are small and slow to score: their tasks are set by number, not by the size of a split or of a shuffle.
    names = rows.select("name").where("name is not null").distinct().repartition(shuffle_width(catalog.sparkSession), F.xxhash64("name"))
    matches = names.withColumn("hits", score("name")).select("name", F.inline("hits"))
    ranked = rows.join(matches, "name").withColumn(
        "rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("ratio"), "path")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("target", "rank", "path", "ratio")
