"""A small hostile table of documents, and plain versions of the operators."""

import hashlib
import random
import re

from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows(seed=3, n=90):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abdeiklmnorstué") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = []
    for i in range(n):
        k = rng.choice([1, 3, 4, 5, 20, 36, 60, 120, 300])
        ws = [rng.choice(vocab) for _ in range(k)]
        if i % 7 == 0:
            at = rng.randint(0, len(ws))
            ws[at:at] = passage
        out.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(ws), rng.choice(["en", "de", None]),
                    rng.choice(["a", "b", "b", "b", None, "é"]), len(ws)))
    base = [rng.choice(vocab) for _ in range(200)]
    for j in range(25):                      # near copies, chained edits
        base = list(base)
        base[rng.randrange(len(base))] = f"edit{j}"
        out.append((n + j, " ".join(base), "en", "b", 0))
    copy = out[5][1] + " tail of a copy that is long enough"
    out += [(n + 30 + j, copy if j % 2 else copy.upper(), "en", "b", 0) for j in range(12)]
    twice = " ".join(passage[:40])
    out += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n", "en", "a", 3),
            (203, twice + " middle " + twice, "en", "a", 1), (204, "x" * 5000, "en", "a", 1),
            (205, "<|endoftext|> a  <|endoftext|>\n<|endoftext|>  b", "en", "a", 1),
            (206, "Straße É́ café İSTANBUL ΣΑΣ x y \x1c\x1d z' it's we'LL 12３ ½ ​😀😀", "de", "é", 1),
            (207, "tab\there  two   three\n\nnl \n x\r\n\r\n y ", "en", "a", 1),
            (208, "long " * 20000, "en", "a", 1), (209, "one two three", "en", "a", 1), (210, "ONE two three", "en", "a", 1),
            (211, "[TURN:user]</s><|im_end|>[\\/TURN] \\ [[INST]", "en", "a", 1), (212, "### *** $$$ 123", "en", "a", 1),
            (212, "### *** $$$ 123", "en", "a", 1), (None, "no id at all here", "en", "a", 1), (None, None, "en", "a", 1)]
    return out


def frame(spark, more=True, data=None):
    """The table, in several partitions, with columns whose names clash."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
    if more:
        for c in ("rid", "size", "copies", "bucket", "k", "cid", "label", "n", "shard", "slot", "target", "tail", "accepted"):
            df = df.withColumn(c, F.lit(7))
    return df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(t, k):
    ws = words(lower(t or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def jaccard_components(data, k, percent):
    """``{row index: (size, component)}`` by comparing all pairs."""
    sets = [shingle_set(r[1], k) for r in data]
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    first = {}
    for i, r in enumerate(data):
        ids = [x for x in (first.get(find(i)), r[0]) if x is not None]
        first[find(i)] = min(ids) if ids else None
    return [(r[0], len(sets[i]), first[find(i)]) for i, r in enumerate(data)]


def removed(data, w):
    """``[(doc_id, n_words, n_removed, kept)]`` by counting all windows."""
    from collections import Counter
    ws = [words(r[1]) for r in data]
    seen = Counter(tuple(x[i:i + w]) for x in ws for i in range(len(x) - w + 1))
    out = []
    for r, x in zip(data, ws):
        gone = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i:i + w])] > 1:
                gone.update(range(i, i + w))
        out.append((r[0], len(x), len(gone), " ".join(y for i, y in enumerate(x) if i not in gone)))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)
