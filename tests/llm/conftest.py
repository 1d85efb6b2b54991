from __future__ import annotations

import random

import pytest

INSULTS = ("blorgh", "snarfle", "quizzab")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rnd: random.Random, n: int, lang: str = "xx") -> str:
    parts = {"xx": ("the", "and", "lor", "ham", "ti", "sen", "ow"), "yy": ("der", "und", "ich", "zu", "ße", "kru", "ä"), "zz": ("que", "los", "ci", "ñon", "da", "re", "é")}[lang]
    common = parts[:2]
    words = [rnd.choice(common) if rnd.random() < 0.35 else "".join(rnd.choice(parts[2:]) for _ in range(rnd.randint(2, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


def rows(seed: int = 1, n: int = 240) -> list[tuple]:
    """Prose in three languages, toxic words in every eighth text, copies, near copies and odd cases."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        lang = ("xx", "yy", "zz")[i % 3]
        text = prose(rnd, rnd.randint(60, 200), lang)
        if i % 8 == 0:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
            text = " ".join(words)
        out.append((i, text, lang, f"s{i % 4}", len(text)))
    for i in range(30):  # copies, one with other white space
        _, t, lang, s, c = out[i * 3 + 1]
        out.append((1000 + i, t if i % 2 else t.replace(" ", "  "), lang, s, c))
    long = prose(rnd, 4000, "xx")
    for i in range(12):  # near copies of a long text
        w = long.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        out.append((2000 + i, " ".join(w), "xx", "s0", 0))
    odd = [None, "", " \t\n", "word", "one two", "line one here\nline one here\n\n \nline one here", "123 456 !!", "a" * 5000, "<|endoftext|> x<|endoftext|>", "é😀\x85 'll don't\r\n"]
    out += [(3000 + i, t, None if i % 2 else "xx", None, None) for i, t in enumerate(odd)]
    out += [(3001, "", None, None, None), (5, out[5][1], out[5][2], out[5][3], out[5][4]), (None, "no id at all", "xx", "s1", 3)]
    return out


@pytest.fixture(scope="session")
def data() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def labels(spark, data):
    known = [(r[0], 1, int(any(w in (r[1] or "") for w in INSULTS))) for r in data if r[0] is not None and r[0] < 1000]
    return spark.createDataFrame([*known, (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """Columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(1) for c in ("score", "fp", "row", "salt", "kept", "length", "bucket", "group", "size", "maybe", "shard", "kind", "bits", "label", "words", "sha", "points", "parts", "part", "node", "class", "c0", "c1", "gone", "keep", "bloom_page",
                                       "bloom_map", "__sha", "__points", "__salt", "__maybe", "__gone", "__node", "__text", "__n_words", "__kept", "__row", "text_", "lang_")}
    return docs.withColumns(extra)
