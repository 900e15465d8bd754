"""Quality rules: simple text counts, and divergence from language references.

Two histograms describe a document: its characters by class, and its words by membership in the
list of common words of a language (one cell per common word, one for all others). References hold
the same histograms of ordinary documents of each language. The verdict takes the Jensen-Shannon
distance (base 2, between 0 and 1) to the nearest reference, and rejects a document whose distance
is above the limit. Histograms of little text are noise, so each distance is judged only from a
minimum number of words on (the guards); below it that distance rejects nothing. Nor does any reject
a document labelled with a language of too few texts for a reference.

Only DataFrame functions run here. Defined results: a null or empty text has no words, counts of 0
and fails the base rules; a null language adds nothing to the references; repeated rows are judged
alike; an empty table, or one without any language, gives no reference and then only the base rules
judge; all input columns stay, but a result replaces an input column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsieve.functions.common import fence, let
from idsieve.operators.ordered import top_k_per_key
from idsieve.llm.shared import by_copies, written
from idsieve.llm.words import held, released, words

#: Character classes, each a set of code points; what is left is "other".
CLASSES = (
    ("lower", r"\p{Ll}"), ("upper", r"\p{Lu}"), ("digit", r"\p{Nd}"),
    ("stop", r"[.,;:!?'\"()\-]"), ("symbol", r"[#*$%&|<>=+/\\@^~_{}\[\]]"),
)
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 24
    min_words_for_chars: int = 50
    min_words_for_common: int = 80
    max_char_distance: float = 0.27
    max_word_distance: float = 0.38
    #: Distinct texts that the references of each language are fitted on: all, or about so many by a hash of the text.
    fit_rows: int | None = None
    #: A language whose reference has fewer texts is too little known: documents labelled with it are not judged by distances.
    min_texts: int = 30


@dataclass(frozen=True)
class Reference:
    """Per language the shares of the character classes, and of its common words."""

    lang: str
    chars: tuple[float, ...]
    common: tuple[tuple[str, float], ...]
    texts: int | None = None  # that it was fitted on; None counts as enough


def class_counts(glued: Column) -> Column:
    """Array of the counts of every class in a document's words glued together, the rest last.

    Each class is taken out of what earlier ones left, so only the first pass sees the whole text.
    """
    def step(left: Column, rest: tuple) -> Column:
        if not rest:
            return F.array(F.length(left).cast("long"))
        taken = F.regexp_replace(left, rest[0][1] + "+", "")
        return let(taken, lambda t: F.concat(F.array((F.length(left) - F.length(t)).cast("long")), step(t, rest[1:])))

    return step(glued, CLASSES)


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``w``.

    Window hashes with their places are sorted once, so equal windows stand side by side; the
    places of repeated ones, in order, each cover up to three words that the next does not.
    """
    n = F.size(w)

    def covered(places: Column) -> Column:
        k = F.size(places)
        gaps = F.transform(places, lambda p, i: F.when(i + 1 < k, F.least(F.get(places, i + 1) - p, F.lit(3))).otherwise(3))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        k = F.size(s)
        at = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                      | ((i + 1 < k) & (F.get(s, i + 1)["h"] == x["h"])))
        return let(F.sort_array(F.transform(at, lambda x: x["i"])), covered)

    def placed(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return let(F.sort_array(pairs), repeated)

    def twice(both: Column) -> Column:
        # A few repeated hashes are looked for one by one; for many, windows are sorted with their places.
        h, twins = both["h"], both["twins"]
        few = let(F.transform(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twins, x), i)),
                                       lambda i: i.isNotNull()), lambda i: i), covered)
        return (F.when(F.size(twins) == 0, F.lit(0).cast("long")).when(F.size(twins) <= 12, few)
                .otherwise(placed(h)))

    def with_twins(h: Column) -> Column:
        twins = F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<bigint>")).otherwise(
            let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)))))
        return let(F.struct(h.alias("h"), twins.alias("twins")), twice)

    hashes = F.transform(F.slice(w, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, with_twins))


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_w", words(F.col("text"))).withColumn("_glued", F.array_join("_w", ""))


def base_counts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The counts of the base rules beside the input columns, and ``_w``/``_glued`` for further use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    dup = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    out = (
        _with_words(docs)
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length("_glued").cast("long"))
        .withColumn("n_symbols", (F.length("_glued") - F.length(F.regexp_replace("_glued", "[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_dup_lines", dup.cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col("_w")))
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _lower(w: Column) -> Column:
    """The words of ``w`` in lower case, as they are looked up in lists of common words."""
    return F.split(F.lower(F.array_join(w, " ")), " ")


def fit_references(docs: DataFrame, rules: Rules = Rules()) -> list[Reference]:
    """References per ``lang``, from all distinct texts of each language that have enough words.

    A text counts once in a language however often it is there; only texts with copies are shuffled. Words are counted once; the classes of characters
    follow from the counts of words. What comes to the driver is one short list per language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.md5("text").alias("digest"))
    if rules.fit_rows is not None:
        sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("digest", 0.02).alias("n")).collect()}
        # Only languages beyond the number are cut to a share.
        large = {x: int(rules.fit_rows / n * (1 << 40)) for x, n in sizes.items() if n > rules.fit_rows}
        limit = reduce(lambda c, x: F.when(F.col("lang") == x, large[x]).otherwise(c), sorted(large), F.lit(1 << 40))
        known = known.filter(F.pmod(F.xxhash64(F.lit("quality"), F.col("text")), F.lit(1 << 40)) < limit)
    # Only texts that are there again are exchanged.
    once, others = by_copies(known, "lang", "text")
    distinct = others.dropDuplicates(["lang", "digest"])
    distinct = distinct if once is None else once.unionByName(distinct)
    texts = distinct.select("lang", words(F.col("text")).alias("_w")).filter(F.size("_w") >= rules.min_words)
    # A null beside the words of a text counts the texts.
    listed = texts.select("lang", F.explode(F.array_append("_w", F.lit(None).cast("string"))).alias("w"))
    counted = written(listed.groupBy("lang", "w").agg(F.count("*").alias("n")), "reference-words")
    n_texts = {r["lang"]: r["n"] for r in counted.filter("w IS NULL").collect()}
    counted = counted.filter("w IS NOT NULL")
    cells = counted.select("lang", "n", class_counts(F.col("w")).alias("c"))
    sums = [F.sum(F.col("c")[i] * F.col("n")).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    summed = {r["lang"]: r for r in cells.groupBy("lang").agg(F.sum("n").alias("n"), *sums).collect()}
    lower = counted.groupBy("lang", F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    top = top_k_per_key(lower, ["lang"], [F.desc("n"), F.asc("w")], rules.common_words, salt_on=F.col("w"))
    common: dict[str, list[tuple[str, float]]] = {}
    for r in top.orderBy("lang", "rank").collect():
        common.setdefault(r["lang"], []).append((r["w"], r["n"] / summed[r["lang"]]["n"]))
    out = []
    for lang in sorted(summed):
        chars = [float(summed[lang][f"c{i}"]) for i in range(len(CLASSES) + 1)]
        whole = sum(chars) or 1.0
        out.append(Reference(lang, tuple(v / whole for v in chars), tuple(common[lang]), n_texts[lang]))
    return out


def _distance(p: Column, q: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of an array of shares ``p`` to the fixed shares ``q``."""
    def part(x: Column, y: Column) -> Column:
        mid = x + y
        return F.when(x > 0, x * F.log2(2 * x / mid)).otherwise(0.0) + F.when(y > 0, y * F.log2(2 * y / mid)).otherwise(0.0)

    parts = F.zip_with(p, F.array(*[F.lit(y) for y in q]), part)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, references: list[Reference], rules: Rules = Rules()) -> DataFrame:
    """Base counts, ``char_distance`` and ``word_distance`` to the nearest language, and ``kept``."""
    results = (*RESULTS, "char_distance", "word_distance")
    labelled = ["lang"] if "lang" in docs.columns else []
    out = base_counts(held(docs, "text", *labelled), rules)
    if not references:
        none = F.lit(None).cast("double")
        out = out.withColumns({"char_distance": none, "word_distance": none, "kept": fence(~F.col("base_failed"))})
        return released(out, docs.columns, *results)
    listed = sorted({w for r in references for w, _ in r.common})
    hits = F.filter(_lower(F.col("_w")), lambda x: x.isin(*listed))
    out = out.withColumn("_c", class_counts(F.col("_glued"))).withColumn(
        "_hits", F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" ")))
    # Every hit stands between two blanks of its own, so removing " word " removes its occurrences alone.
    size = F.octet_length("_hits")
    out = out.withColumn("_n", F.transform(F.array(*[F.lit(w) for w in listed]), lambda w: (
        size - F.octet_length(F.replace(F.col("_hits"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))))
        / (F.octet_length(w) + 2)))
    share = F.transform("_c", lambda x: x / F.greatest(F.col("word_chars"), F.lit(1)))
    by_chars, by_words = [], []
    for ref in references:
        places = F.array(*[F.lit(listed.index(w)) for w, _ in ref.common])
        own = F.transform(places, lambda i: F.get(F.col("_n"), i) / F.greatest(F.col("n_words"), F.lit(1)))
        rest = lambda a: F.greatest(F.lit(0.0), 1.0 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
        q = [s for _, s in ref.common]
        by_chars.append(_distance(F.col("_share"), ref.chars))
        by_words.append(_distance(let(own, lambda a: F.array_append(a, rest(a))), (*q, max(0.0, 1.0 - sum(q)))))
    out = out.withColumn("_share", share)
    least = lambda cols: cols[0] if len(cols) == 1 else F.least(*cols)
    bad = ((F.col("n_words") >= rules.min_words_for_chars) & (F.col("char_distance") > rules.max_char_distance)) | (
        (F.col("n_words") >= rules.min_words_for_common) & (F.col("word_distance") > rules.max_word_distance))
    if labelled:
        enough = [r.lang for r in references if r.texts is None or r.texts >= rules.min_texts]
        bad = bad & (F.col("lang").isNull() | F.col("lang").isin(*enough))
    out = (
        out.withColumn("char_distance", least(by_chars)).withColumn("word_distance", least(by_words))
        .withColumn("kept", fence(~F.col("base_failed") & ~bad))
    )
    return released(out, docs.columns, *results)
