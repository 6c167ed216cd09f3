"""Small tables and brute-force versions used by the tests of the training-data operators."""

import re
import struct

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i % 3001}" for i in range(60_000))
MESSY = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 60),
    (2, "THE quick brown fox jumps over the lazy dog again and again today", "en", "a", 60),
    (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \t\n\x0b ", None, "b", 5),
    (6, "one two", "en", "b", 7), (7, "one two", "en", "b", 7), (8, LONG, "en", "c", len(LONG)),
    (9, "naïve 日本語 😀 text<|endoftext|>more\n\n  spaces", "fr", "c", 40),
    (9, "naïve 日本語 😀 text<|endoftext|>more\n\n  spaces", "fr", "c", 40),
    (None, "a row that has no id but has some words in it", "en", "c", 40),
    (10, "a\nb\na\n \na", "en", "", 9),
]
# Extra columns whose names the operators use themselves.
CLASHES = ["ids", "spans", "kept", "score", "size", "key", "bands", "n_words", "component", "copies", "words", "_in0", "b"]


def messy(spark, clashes=True):
    df = spark.createDataFrame(MESSY, SCHEMA)
    for name in CLASHES if clashes else []:
        df = df.withColumn(name, df.lang)
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows):
    """Smallest reachable id per id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    part = {i: i for i in ids}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: root(i) for i in ids}


def brute_passages(rows, width=20):
    """{id: (words, removed words, kept words)} for rows with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            window = tuple(w[s:s + width])
            if window in seen:
                gone[s:s + width] = [True] * width
            seen.add(window)
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def spark_hash(*values):
    """xxhash64 as Spark computes it for strings and longs."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed
