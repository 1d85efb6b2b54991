"""Quality rules by distribution divergence, in DataFrame operations only.

The base rules count words, symbols, repeated lines and repeated eight-word
windows.  The verdict compares two histograms of a document with references:
its character classes, and its common words.  References are the histograms of
each language over all documents that carry it; a document is compared with
every language and its smallest Jensen-Shannon distance counts, so its own lang
is no input.  Each comparison has a minimum length below which it is not made.

Languages that hold at least 1 in ``SHARE`` of the documents are a bounded number
and stand in the plan.  The references of all others are a table that is joined
by lang: a document of such a language is compared with its own one, too.  Common words are short words (up to
``SHORT`` letters) that make up 0.5 % of their language's words, the 16 most frequent of each.

Defined results: null counts as a text without words, which fails the base
rules; without any reference only the base rules decide; repeated rows and ids
are judged alike, and a null id passes through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SHARE, SHORT, EACH = 100, 5, 16
#: Words from which on each comparison is made, and the distance that it allows.
CLASS_WORDS, CLASS_DISTANCE = 50, 0.33
COMMON_WORDS, COMMON_DISTANCE = 50, 0.42
#: Classes that are counted by what is left of a text without all other characters.
COUNTED = {"upper": "A-Z", "digit": "0-9", "mark": r".,;:'\x22?!()\-", "symbol": r"#*$%&|<>"}
#: With them white space, bytes beyond one a character, and the rest, which are small ASCII letters for the most part.
CLASSES = (*COUNTED, "space", "wide", "rest")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is never computed anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _paired(hashes: Column, gap: int) -> Column:
    """Hashes of each entry with the one ``gap`` places on."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + gap, n), lambda a, b: F.xxhash64(a, b))


def _repeated(windows: Column) -> Column:
    """Words that the windows found twice or more cover, from the array of window hashes."""

    def neighbours(pairs: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        return F.filter(F.transform(pairs, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["i"]).otherwise(-1)), lambda v: v >= 0)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda v, i: F.least(F.coalesce(F.get(at, i + 1) - v, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(_let(pairs, lambda p: F.sort_array(neighbours(p))), covered))


def uncommon(text: Column) -> Column:
    """A text without small ASCII letters and white space, a tenth of it, in which the classes are counted."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def class_counts(text: Column, short: Column, words: Column) -> dict[str, Column]:
    """How many characters of each class a text has, from its ``uncommon`` part, its text in one word, and its bytes."""
    counts = {name: F.length(F.regexp_replace(short, f"[^{inside}]+", "")) for name, inside in COUNTED.items()}
    points = F.length(text)
    counts |= {"space": points - F.length(words), "wide": F.octet_length(text) - points}
    return counts


def rest(points: Column, counts: dict[str, Column]) -> Column:
    return F.greatest(points - sum(counts.values(), F.lit(0)), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, the character classes and the words (columns that begin with ``__``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__words", F.filter(F.split(text, common.SPACE + "+"), lambda w: w != ""))
    df = df.withColumn("__uncommon", uncommon(text))
    df = df.withColumns({f"__{name}": c for name, c in class_counts(text, F.col("__uncommon"), F.array_join("__words", "")).items()} | {"__points": F.length(text)})
    df = df.withColumn("__rest", rest(F.col("__points"), {c: F.col(f"__{c}") for c in CLASSES[:-1]}))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({"__lines": lines, "__hashes": F.transform("__words", lambda w: F.xxhash64(w))})
    n = F.size("__words")
    df = df.withColumn("__windows", _paired(F.col("__hashes"), 1))
    for gap in (2, 4):  # hashes of two, four and eight words
        df = df.withColumn("__windows", _paired(F.col("__windows"), gap))
    return df.withColumns(
        {
            "__n_words": n.cast("long"),
            "__word_chars": (F.col("__points") - F.col("__space")).cast("long"),
            "__n_symbols": F.col("__symbol").cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_repeat_words": _repeated(F.col("__windows")),
        }
    )


class References:
    """Histograms of each language: character classes, and common words with the rest last."""

    def __init__(self, docs: DataFrame) -> None:
        known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
        sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > 0).orderBy(F.desc("n"), "lang").limit(SHARE + 1).collect()}
        languages = sorted(x for x, n in sizes.items() if n * SHARE >= sum(sizes.values()))
        self.classes: list[list[float]] = []
        self.words: list[str] = []
        self.shares: list[list[float]] = []
        #: References of the languages below the share: __own_lang, __own_classes, __own_words, __own_shares.
        self.rare: DataFrame | None = None
        if not sizes:
            return
        text = F.col("text")
        parts = known.select("lang", "text", uncommon(text).alias("short"), F.length(text).alias("points"))
        counts = class_counts(text, F.col("short"), F.regexp_replace(text, common.SPACE + "+", ""))
        parts = parts.select("lang", "points", *(c.alias(name) for name, c in counts.items()))
        parts = parts.withColumn("rest", rest(F.col("points"), {c: F.col(c) for c in CLASSES[:-1]})).groupBy("lang").agg(*(F.sum(c).alias(c) for c in CLASSES))
        # short words under their own name; the others, and the classes, under names that no word has
        totals = parts.select("lang", F.inline(F.array(*(F.struct(F.lit(f" {c}").alias("w"), F.col(c).cast("long").alias("n")) for c in CLASSES))))
        words = known.select("lang", F.explode(F.split(text, common.SPACE + "+")).alias("w")).where("w <> ''")
        short = F.when(F.length("w") <= SHORT, F.lower("w")).otherwise(F.lit(" words"))
        found = words.select("lang", short.alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
        found = common.materialise(docs.sparkSession, found.unionByName(totals), "short-words")
        total = found.where("w = ' words' OR w NOT LIKE ' %'").groupBy("lang").agg(F.sum("n").alias("all_words"))
        if len(sizes) > len(languages):
            self.rare = rare_references(found.where(~F.col("lang").isin(languages)), total)
        often = found.where(F.col("lang").isin(languages)).join(F.broadcast(total.where(F.col("lang").isin(languages))), "lang").where((F.col("n") >= F.col("all_words") / 200) | F.col("w").startswith(" ")).collect()  # 200 and the totals a language, of which there are at most SHARE
        n_of, all_words = {(r["lang"], r["w"]): r["n"] for r in often}, {r["lang"]: r["all_words"] for r in often}
        top = {x: sorted((r for r in often if r["lang"] == x and r["w"][0] != " "), key=lambda r: (-r["n"], r["w"]))[:EACH] for x in languages}
        self.words = sorted({r["w"] for rows in top.values() for r in rows})
        for x in languages:
            c = [n_of.get((x, f" {name}"), 0) for name in CLASSES]
            n = all_words.get(x, 0)
            if not sum(c):
                continue
            self.classes.append([v / sum(c) for v in c])
            w = [n_of.get((x, word), 0) for word in self.words]
            self.shares.append([v / max(n, 1) for v in [*w, n - sum(w)]])


def rare_references(found: DataFrame, total: DataFrame) -> DataFrame:
    """The histograms of each language in ``found`` (lang, w, n), as arrays in a row."""
    classes = found.where(F.col("w").isin([f" {c}" for c in CLASSES])).groupBy("lang").pivot("w", [f" {c}" for c in CLASSES]).agg(F.sum("n"))
    inside = [F.coalesce(F.col(f"` {c}`"), F.lit(0)) for c in CLASSES]
    all_chars = F.greatest(sum(inside, F.lit(0)), F.lit(1)).cast("double")
    classes = classes.select("lang", F.array(*(c / all_chars for c in inside)).alias("__own_classes"))
    often = found.join(total, "lang").where((F.col("n") >= F.col("all_words") / 200) & ~F.col("w").startswith(" "))
    top = often.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("at") <= EACH)
    words = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("w", (F.col("n") / F.col("all_words")).alias("p")))).alias("top"))
    shares = F.coalesce(F.col("top.p"), F.array().cast("array<double>"))
    rest_share = F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    out = classes.join(words, "lang", "left").withColumnRenamed("lang", "__own_lang")
    return out.select("__own_lang", "__own_classes", F.coalesce("top.w", F.array().cast("array<string>")).alias("__own_words"), F.concat(shares, F.array(rest_share)).alias("__own_shares"))


def jensen_shannon(p: Column, q: list[float] | Column) -> Column:
    """Distance (root of the divergence in bits) of the histogram ``p``, an array that sums to one, from ``q``."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q if isinstance(q, Column) else F.array(*map(F.lit, q)), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judged(docs: DataFrame, references: References) -> DataFrame:
    """``docs`` with the base counts, ``__class_distance``, ``__word_distance``, ``__base_failed`` and ``__kept``."""
    if references.rare is not None:
        docs = docs.join(references.rare, F.col("lang") == F.col("__own_lang"), "left")
    df = measured(docs)
    inside = [F.col(f"__{name}") for name in CLASSES]
    total = F.greatest(sum(inside, F.lit(0)), F.lit(1)).cast("double")
    df = df.withColumn("__class_share", F.array(*((c / total) for c in inside)))
    if references.words:
        # only the common words, each between spaces of its own, so that a count is a difference of lengths
        low = F.transform("__words", lambda w: F.lower(w))
        df = df.withColumn("__common", F.concat(F.lit(" "), F.array_join(F.filter(low, lambda w: w.isin(references.words)), "  "), F.lit(" ")))
        counts = [((F.octet_length("__common") - F.octet_length(F.replace(F.col("__common"), F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)) for w in references.words]
        df = df.withColumn("__counts", F.array(*counts))
        n = F.greatest(F.size("__words"), F.lit(1)).cast("double")
        share = F.transform("__counts", lambda c: c / n)
        df = df.withColumn("__word_share", F.concat(share, F.array(F.lit(1.0) - F.aggregate(share, F.lit(0.0), lambda a, x: a + x))))
        df = df.withColumn("__word_distance", F.array_min(F.array(*(jensen_shannon(F.col("__word_share"), q) for q in references.shares))))
    else:
        df = df.withColumn("__word_distance", F.lit(0.0))
    df = df.withColumn("__class_distance", F.array_min(F.array(*(jensen_shannon(F.col("__class_share"), q) for q in references.classes))) if references.classes else F.lit(0.0))
    if references.rare is not None:
        # least() passes over the null of a document without such a reference
        n = F.greatest(F.size("__words"), F.lit(1)).cast("double")
        mine = F.filter(F.transform("__words", lambda w: F.lower(w)), lambda w: F.array_contains("__own_words", w))
        share = _let(mine, lambda m: F.transform("__own_words", lambda w: F.size(F.filter(m, lambda x: x == w)) / n))
        own = _let(share, lambda p: F.concat(p, F.array(F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))))
        words = F.when(F.col("__own_lang").isNotNull(), jensen_shannon(own, F.col("__own_shares")))
        df = df.withColumn("__word_distance", F.least("__word_distance", words) if references.words else F.coalesce(words, F.lit(0.0)))
        classes = F.when(F.col("__own_lang").isNotNull(), jensen_shannon(F.col("__class_share"), F.col("__own_classes")))
        df = df.withColumn("__class_distance", F.least("__class_distance", classes) if references.classes else F.coalesce(classes, F.lit(0.0)))
    failed = (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))
    odd = ((F.col("__n_words") >= CLASS_WORDS) & (F.col("__class_distance") > CLASS_DISTANCE)) | ((F.col("__n_words") >= COMMON_WORDS) & (F.col("__word_distance") > COMMON_DISTANCE))
    return df.withColumn("__base_failed", failed).withColumn("__kept", ~failed & ~odd)


def quality(docs: DataFrame) -> DataFrame:
    """The counts and the verdict of every document."""
    out = judged(docs.select("doc_id", "text", "lang"), References(docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    return out.select("doc_id", *(F.col(f"__{n}").alias(n) for n in names))


def drop_poor(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with all their columns.

    The optimiser would move the filter below the projections and write out the
    verdict in full there, of a size that doubles with each of them.  It moves no
    filter past a row number, so one stands beside the verdict.
    """
    mine = common.Renamed(docs)
    text, lang = mine.name("text"), mine.name("lang")
    named = mine.df.withColumnRenamed(text, "text").withColumnRenamed(lang, "lang")
    out = judged(named, References(named)).withColumn("__row", F.monotonically_increasing_id())
    return mine.back(out.where("__kept AND __row >= 0").withColumnRenamed("text", text).withColumnRenamed("lang", lang))
