"""Languages by their letters: naive Bayes over runs of one to three characters.

Profiles are counted from sample texts. A text gets, for every language, the sum of
the weights of its runs; runs that no sample holds say nothing. The sums of forty languages per run
are beyond what expressions on arrays do at a fair price, so one Arrow function looks the runs up and
adds the weights; cleaning before it and the verdict after it are Column expressions.
"""

import functools
import math
import sys
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..samples import LANGUAGES

# The function travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 3
# Share of all runs that a run is granted in samples without it.
SMOOTH = 0.0003
# Weights are natural logarithms in thousandths, as whole numbers.
SCALE = 1000
NO_LETTER = r"[^\p{L}\p{M}]+"
SCORE_TYPE = "struct<best:int,lead:bigint,runs:bigint,longest:bigint,chars:bigint>"


def runs_of(text: str) -> Counter:
    """The runs of a cleaned text; no run has a blank within."""
    found = Counter()
    for n in range(1, LONGEST + 1):
        found.update(text[i : i + n] for i in range(len(text) - n + 1) if text[i : i + n] != " " and " " not in text[i + 1 : i + n - 1])
    return found


def cleaned_sample(text: str) -> str:
    """What `cleaned` makes of a sample."""
    return " " + " ".join("".join(c if category(c)[0] in "LM" else " " for c in text.lower()).split()) + " "


@functools.cache
def profiles(samples: tuple[str, ...]) -> dict[str, list[int]]:
    """Run -> one weight per sample, in the order of the samples."""
    counts = [runs_of(cleaned_sample(sample)) for sample in samples]
    runs = sorted(set().union(*counts))
    distinct = Counter(map(len, runs))
    totals = [Counter() for _ in counts]
    for total, count in zip(totals, counts):
        for run, k in count.items():
            total[len(run)] += k
    return {
        run: [
            math.floor(SCALE * math.log((count[run] / total[len(run)] + SMOOTH) / (1 + SMOOTH * distinct[len(run)])) + 0.5)
            for count, total in zip(counts, totals)
        ]
        for run in runs
    }


class Tables:
    """Profiles as arrays: for each length the runs' keys, ascending, and their weights."""

    def __init__(self, weights: dict[str, list[int]]):
        # Characters of samples are numbered from 1; blank is 1, all others count as 0.
        letters = sorted(set("".join(weights)))
        self.number = np.zeros(max(map(ord, letters)) + 1, np.int64)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.blank, self.base = int(self.number[ord(" ")]), len(letters) + 1
        self.place, self.weights = [], []
        for n in range(1, LONGEST + 1):
            runs = [r for r in weights if len(r) == n]
            keys = self.keys([self.number[[ord(r[i]) for r in runs]] for i in range(n)])
            # By key, the run's place among the weights; the last place has none.
            place = np.full(self.base**n, len(runs), np.int16 if len(runs) < 1 << 15 else np.int32)
            place[keys] = np.arange(len(runs))
            self.place.append(place)
            # Whole numbers as doubles: sums stay exact, and products are quick.
            self.weights.append(np.array([weights[r] for r in runs], float))

    def keys(self, numbers):
        key = numbers[0]
        for more in numbers[1:]:
            key = key * self.base + more
        return key

    def score(self, text: str):
        """(best language, its lead over the second, number of runs known, number of the longest among them, characters)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        numbers = np.where(points < len(self.number), self.number[np.minimum(points, len(self.number) - 1)], 0)
        total, runs, longest = 0, 0, 0
        for n, (place, weights) in enumerate(zip(self.place, self.weights), 1):
            m = len(numbers) - n + 1
            if m < 1:
                break
            found = np.bincount(place[self.keys([numbers[i : i + m] for i in range(n)])], minlength=len(weights) + 1)[:-1]
            total = total + found.astype(float) @ weights
            longest = int(found.sum()) if n == LONGEST else 0
            runs += int(found.sum())
        if not runs:
            return None
        order = np.argsort(-total, kind="stable")
        return int(order[0]), int(total[order[0]] - total[order[1]]), runs, longest, len(numbers)


def cleaned(text: Column) -> Column:
    """Letters in lower case, everything else a single blank, blanks at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), NO_LETTER, " ")), F.lit(" "))


def language_scores(text: Column, languages=LANGUAGES) -> Column:
    """(best, lead, runs, longest, chars): the best language's number, its lead over the second, how many runs were
    known, how many of the longest, and how many characters the cleaned text has.

    NULL for a NULL text and where no run is known.
    """
    weights = profiles(tuple(sample for _, sample in languages.values()))

    @F.arrow_udf(SCORE_TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = Tables(weights)
        for batch in batches:
            found = [t.is_valid and tables.score(t.as_py()) or None for t in batch]
            parts = [pa.array([f and f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), *[pa.int64()] * 4))]
            mask = pa.array([f is None for f in found], pa.bool_())
            yield pa.StructArray.from_arrays(parts, ["best", "lead", "runs", "longest", "chars"], mask=mask)

    return run(cleaned(text))
