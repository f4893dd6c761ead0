"""Quality rules: text statistics in Spark SQL and decision lists learned from labelled rows.

Everything here is DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import whole_row
from tessera.session import materialize

#: The characters that count as symbols, and white space that separates words.
SYMBOLS = "[#*$%&|<>]"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
EDGE_SPACES = r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"
PLAIN_SPLIT = r"""[\x20\x09-\x0D.,;:!?"'()\[\]{}]+"""

#: Bounds of the fit: labelled rows used (those with the least hashes of their doc_id),
#: flagged stems, thresholds tried for a statistic, rules, conditions of a rule.
FIT_ROWS = 8_000
FLAG_STEMS = 256
STEM_CHARS = 5
CUTS = 24
MAX_RULES = 10
MAX_CONDITIONS = 3
MIN_PRECISION = 0.97
MIN_COVER = 12
#: Words of the shortest text that passes the base rule.
LEAST_WORDS = 50

FEATURES = ("word_len", "symbol_share", "upper_share", "bang_share", "dup_line_share", "repeat_share", "line_words", "digit_share", "flag_words", "flag_share", "flag_stems", "stem_share", "n_words")


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable, not an inlined expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first included.

    Windows whose 32-bit hashes meet are found by one sort of longs (hash, place); the
    few that meet are sorted again by their words, so the count is exact.
    """

    def from_keys(keys: Column) -> Column:
        h = lambda x: F.shiftright(x, 32)
        met = F.filter(
            keys,
            lambda x, i: ((i > 0) & (h(F.get(keys, i - 1)) == h(x))) | (h(F.get(keys, i + 1)) == h(x)),
        )
        return F.when(F.size(met) > 0, _bind(met, from_met)).otherwise(F.lit(0).cast("long"))

    def from_met(met: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        named = F.array_sort(F.transform(met, lambda x: F.struct(F.concat_ws(" ", F.slice(words, place(x) + 1, 3)).alias("w"), place(x).alias("p"))))
        return _bind(named, from_named)

    def from_named(named: Column) -> Column:
        twice = F.filter(named, lambda x, i: ((i > 0) & (F.get(named, i - 1)["w"] == x["w"])) | (F.get(named, i + 1)["w"] == x["w"]))
        return _bind(F.sort_array(F.transform(twice, lambda x: x["p"])), from_places)

    def from_places(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    n = F.size(words)
    keys = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.shiftleft(F.hash(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).cast("long"), 32).bitwiseOR(i.cast("long")),
        )
    )
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_bind(keys, from_keys))


def _matches(text: Column, pattern: str) -> Column:
    """Characters of a text that a character class matches; cheap where few do."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def _stems(text: Column) -> Column:
    """First STEM_CHARS letters of each lower-cased word, punctuation aside."""
    return F.transform(F.split(F.lower(text), PLAIN_SPLIT), lambda w: F.left(w, F.lit(STEM_CHARS)))


def text_statistics(docs: DataFrame, strong: tuple[str, ...] = (), weak: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of each whole text: the four counts of the base rule and the shares that rules may test.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and
    FEATURES.  A null or empty text has no words and zero counts; shares of nothing are 0.
    flag_words counts the words whose stem is in ``strong``, flag_stems those whose stem
    is in ``weak``.  One row for each document row, repeated rows and null ids included;
    other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("t"))

    def measure(words: Column) -> list[Column]:
        lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        count = lambda stems, known: F.size(F.filter(stems, lambda w: w.isin(*known))) if known else F.lit(0)
        hits = _bind(_stems(F.col("t")), lambda x: F.struct(count(x, strong).alias("strong"), count(x, weak).alias("weak"))) if strong or weak else F.struct(F.lit(0).alias("strong"), F.lit(0).alias("weak"))
        return [
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _matches(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
            _bind(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            _matches(F.col("t"), r"\p{Lu}").alias("n_upper"),
            _matches(F.col("t"), "!").alias("n_bang"),
            _matches(F.col("t"), "[0-9]").alias("n_digit"),
            hits.alias("flags"),
        ]

    # One lambda variable holds the words, so that the split runs once for each text.
    trimmed = F.regexp_replace("t", EDGE_SPACES, "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT))
    # Explode keeps later filters from computing the statistics once more for each use.
    counted = (
        base.select("doc_id", F.explode(F.transform(F.array(words), lambda w: F.struct(*measure(w)))).alias("m")).select("doc_id", "m.*")
        .withColumns({"n_lines": F.col("lines.all"), "n_dup_lines": F.col("lines.dup"), "flag_words": F.col("flags.strong"), "flag_stems": F.col("flags.weak")}).drop("lines", "flags")
    )
    chars, n, lines = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return counted.withColumns(
        {
            "word_len": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / n,
            "upper_share": F.col("n_upper") / chars,
            "bang_share": F.col("n_bang") / n,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "repeat_share": F.col("n_repeat_words") / n,
            "line_words": F.col("n_words") / lines,
            "digit_share": F.col("n_digit") / chars,
            "flag_share": F.col("flag_words") / n,
            "stem_share": F.col("flag_stems") / n,
        }
    ).drop("n_lines", "n_upper", "n_bang", "n_digit")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return (F.col(self.feature) > self.cut) if self.above else (F.col(self.feature) <= self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return f"IF {' AND '.join(map(str, self.conditions))} THEN reject  -- {self.precision:.3f} of {self.covered}"


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, bad, toxic, part) of at most ``rows`` labelled documents, those with the least hash of their id.

    bad is 1 for low quality or toxic.  Rows without both labels are left out; of
    repeated labels of a document the worst counts.  A third of the sample prunes.
    """
    judged = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    judged = materialize(judged, "judged")
    # At most ``rows`` rows of three numbers: a proven bound for the broadcast.
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(judged), "doc_id")
        .dropDuplicates(["doc_id"])
        .withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)))
    )


def flagged_stems(sample: DataFrame, most: int = FLAG_STEMS) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strong, weak) stems that mark toxic texts in the labelled sample, chosen by greedy covering.

    A stem counts once for a text.  A strong one stands in five texts or more, nine in
    ten of them toxic; a weak one stands in four standard deviations and two more toxic
    texts than chance gives.  The stem of most toxic texts is taken, its texts are set
    aside, and so on while a stem marks three texts and a hundredth of the toxic ones
    more; what rides along in copies of one toxic text is so passed over.  A strong stem
    of ten toxic texts and a twentieth of all is taken in any case.
    """
    own = materialize(sample.filter("part <> 0").select("toxic", F.array_distinct(_stems(F.col("text"))).alias("stems")), "stems")
    sums = own.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not sums["toxic"]:
        return (), ()
    base = sums["toxic"] / sums["n"]
    is_strong = (F.col("n") >= 5) & (F.col("n_toxic") >= 0.9 * F.col("n"))
    is_weak = F.col("n_toxic") >= base * F.col("n") + 4 * F.sqrt(base * (1 - base) * F.col("n")) + 2
    candidates = (
        own.select("toxic", F.explode("stems").alias("stem")).filter("stem <> ''").groupBy("stem")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))
        .withColumn("strong", is_strong).filter(is_strong | is_weak).orderBy(F.desc("n_toxic"), "stem").limit(most).select("stem", "strong", "n_toxic")
    )
    found = candidates.collect()  # at most ``most`` stems
    known = {r["stem"]: r["strong"] for r in found}
    if not known:
        return (), ()
    marked = own.filter("toxic = 1").select(F.array_intersect("stems", F.array(*[F.lit(w) for w in known])).alias("stems"))
    marks = [frozenset(r["stems"]) for r in marked.collect()]  # at most the sample's rows, of at most ``most`` stems
    taken = [r["stem"] for r in found if r["strong"] and r["n_toxic"] >= max(10, 0.05 * sums["toxic"])]
    while len(taken) < len(known):
        marks = [m for m in marks if m.isdisjoint(taken)]
        counts = Counter(w for m in marks for w in m)
        top = min(counts, key=lambda w: (-counts[w], w), default=None)
        if top is None or counts[top] < max(3, 0.01 * sums["toxic"]):
            break
        taken.append(top)
    return tuple(w for w in taken if known[w]), tuple(w for w in taken if not known[w])


def learn_rules(stats: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """A decision list by sequential covering over ``stats``(FEATURES, bad, part).

    Rules grow on parts 1 and 2, one threshold at a time by information gain (FOIL),
    and are pruned on part 0 while that doesn't lower their precision there.  A rule must be right on
    MIN_PRECISION of all that it covers, and of what it covers in part 0 if that is MIN_COVER rows.  Spark finds
    the thresholds and puts each value in its bin; the driver covers the bins, which are at most the
    sample's rows of one small number for each statistic.
    """
    # Most statistics are zero on most rows: zero is a threshold, the others are quantiles of what is above it.
    steps = F.array(*[F.lit((i + 0.5) / CUTS) for i in range(CUTS)])
    row = stats.agg(*[F.percentile(F.when(F.col(f) > 0, F.col(f)), steps).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({0.0, *(float(x) for x in row[f] or [])}) for f in FEATURES}
    # The bin of a value is the number of cuts below it.
    below = lambda f: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col(f)))
    rows = [(r["bad"], r["part"], r["bins"]) for r in stats.select("bad", "part", F.array(*[below(f) for f in FEATURES]).alias("bins")).collect()]
    number = {f: i for i, f in enumerate(FEATURES)}

    def holds(condition: Condition, bins: list[int]) -> bool:
        # A value is above the cut of place b if more than b cuts are below it.
        return (bins[number[condition.feature]] > cuts[condition.feature].index(condition.cut)) == condition.above

    def grow(left: list[tuple]) -> tuple[int, int, list[tuple[Condition, int, int]]]:
        """(bad, all) of the rows and of each condition on them."""
        p0, n0, out = sum(r[0] for r in left), len(left), []
        for f, i in number.items():
            bad, every = Counter(), Counter()
            for r in left:
                every[r[2][i]] += 1
                bad[r[2][i]] += r[0]
            p = n = 0
            for b, cut in enumerate(cuts[f]):
                p, n = p + bad[b], n + every[b]
                out += [(Condition(f, True, cut), p0 - p, n0 - n), (Condition(f, False, cut), p, n)]
        return p0, n0, out

    rules: list[Rule] = []
    for _ in range(max_rules):
        grown: list[Condition] = []
        left = [r for r in rows if r[1] != 0]
        p0, n0, tests = grow(left)
        while p0 >= MIN_COVER and len(grown) < max_conditions and p0 < n0:
            gain = lambda t: t[1] * (math.log2(t[1] / t[2]) - math.log2(p0 / n0)) if t[1] >= MIN_COVER else -1.0  # noqa: E731, B023
            best = max(tests, key=gain)
            if gain(best) <= 1e-9:
                break
            grown.append(best[0])
            left = [r for r in left if holds(best[0], r[2])]
            if best[1] == best[2]:
                break
            p0, n0, tests = grow(left)
        if not grown:
            break
        choices = []
        for i in range(len(grown)):
            hit = [r for r in rows if all(holds(c, r[2]) for c in grown[: i + 1])]
            held = [r for r in hit if r[1] == 0]
            right, right_held = sum(r[0] for r in hit) / max(len(hit), 1), sum(r[0] for r in held)
            if right >= MIN_PRECISION and (len(held) < MIN_COVER or right_held >= MIN_PRECISION * len(held)):
                choices.append((round((right_held + 1) / (len(held) + 2), 3), -i, right, len(hit)))
        if not choices:
            break
        _, i, right, covered = max(choices)
        rules.append(Rule(tuple(grown[: 1 - i]), right, covered))
        rows = [r for r in rows if not all(holds(c, r[2]) for c in rules[-1].conditions)]
    return rules


@dataclass(frozen=True)
class QualityModel:
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    rules: tuple[Rule, ...]


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, stems: int = FLAG_STEMS, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> QualityModel:
    """Fit flagged stems and the decision list on at most ``rows`` labelled documents.

    Without labelled rows of both kinds the model has no rules and rejects nothing.
    """
    sample = materialize(labelled_sample(docs, labels, rows), "sample")
    strong, weak = flagged_stems(sample, stems)
    stats = text_statistics(sample, strong, weak).join(F.broadcast(sample.select("doc_id", "bad", "part")), "doc_id")
    return QualityModel(strong, weak, tuple(learn_rules(materialize(stats.select("bad", "part", *FEATURES), "stats"), max_rules, max_conditions)))


def judge(docs: DataFrame, model: QualityModel, least_words: int = LEAST_WORDS) -> DataFrame:
    """Statistics of each document with base_failed, rule (number of the first rule that fires, or null) and kept.

    The base fails texts of fewer than ``least_words`` words and those of which over half the words repeat.
    """
    stats = text_statistics(docs, model.strong, model.weak)
    fired = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(model.rules, 1))):
        fired = F.when(rule.column(), F.lit(i)).otherwise(fired)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", fired).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_quality(docs: DataFrame, labels: DataFrame, least_words: int = 1) -> DataFrame:
    """The documents that the base rule and the learned list keep, with all their columns.

    A short text is not bad for being short: from ``least_words`` words on the list and repetition decide.  Statistics stand beside each row, so repeated rows and null ids need no join.
    """
    model = fit_quality(docs, labels)
    whole = docs.select(whole_row(docs).alias("doc_id"), F.col("text"))
    return judge(whole, model, least_words).filter("kept").select("doc_id.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = judge(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}
