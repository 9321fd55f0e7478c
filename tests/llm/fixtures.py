"""Small corpora with everything that a corpus can hold."""

import random

WORDS = "river stone cloud maple ember frost candle meadow silver harbor lantern willow copper thunder velvet orchard pebble saddle timber violet walnut anchor basket cactus dagger falcon garnet hammer island jungle kettle ladder magnet needle oyster parrot quartz ribbon sailor tunnel".split()

#: Columns whose names clash with those that the operators make.
CLASHES = "n_words int, fingerprint string, uid long, key long, root long, group_id long, keep boolean, shard string, n_tokens int, words string, rate double, copies int, batch int, line string, h1 long, containment double, toxic int, __uid long"
CLASH_VALUES = (1, "x", 2, 3, 4, 5, True, "s", 6, "w", 0.5, 2, 1, "l", 7, 0.1, 1, 9)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice([",", ".", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def odd_rows():
    long = prose(1, 20_000)
    return [
        (1, prose(2, 60), "en", "a", 1), (1, prose(2, 60), "en", "a", 1), (1, prose(3, 60), "en", "a", 1), (2, "", "en", None, 0), (3, None, None, "b", None), (None, prose(4, 60), "fr", "b", 5),
        (None, None, None, None, None), (4, "   \n\n ", "de", "a", 4), (5, "word", "en", "c", 4), (6, long, "en", "a", len(long)), (7, "x" * 100_000, "en", "b", 100_000), (8, "Ünïcödé ñ 日本語 \U0001f600 \u0000 end", "es", "c", 3),
        (9, "!!! ??? ...", "en", "a", 5), (10, prose(2, 60).upper(), "en", "b", 9), (11, "same line here now\nsame line here now\nsame line here now", "en", "a", 3), (2**62, prose(9, 7), "en", "a", 1),
    ]


def frame(spark, rows, clashes=False):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clashes:
        return spark.createDataFrame([(*r, *CLASH_VALUES) for r in rows], f"{schema}, {CLASHES}")
    return spark.createDataFrame(rows, schema)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
