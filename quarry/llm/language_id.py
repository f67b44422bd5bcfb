"""Language identification by Bayesian evidence fusion.

For each row the log posterior of a language is the sum of

* the text's log likelihood under character trigram models of the words
  (whole texts; letters of markup are left out), tempered because neighbouring
  trigrams depend on each other,
* the log likelihood of the declared markup language,
* the log likelihood of the address suffix (country codes),
* the log prior of the row's host: soft counts of the text posteriors of all
  rows, grouped by host, smoothed towards the host's domain, that towards all
  rows.  A row's own count is taken out of its host first.

One more class, ``und``, stands for text that is no language: its trigrams
are all equally likely.  A row is accepted if a language wins and its
posterior reaches ``ACCEPT``.

Models are trained here for every label, on a bounded sample of its rows
(``TRAIN_ROWS`` rows and ``MAX_GRAMS`` trigrams a language); everything else
covers all rows.

Null, empty and letterless texts are ``und`` and not accepted, whatever is
declared.  Unknown or null declarations, suffixes and hosts are no evidence.
Repeated rows are rows of their own; without labelled rows nothing but
letterless text is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, row_key, texts_of, worker_memo

TRAIN_ROWS, MAX_GRAMS = 400, 50_000
TEMPER = 1 / 3          # a trigram shares two characters with the next
TRUST_DECLARED, TRUST_SUFFIX = 0.9, 0.8
SMOOTH = 20.0           # rows that the level above weighs in the prior of a host
ACCEPT = 0.5
SALTS = 32              # parts that a host's rows are dealt to
PARTS = 64              # parts that a language's rows are dealt to in the choice of training rows
PART_WORDS, CACHE_WORDS = 50_000, 400_000    # words of a text at a time, words that a worker remembers
CELLS = 1 << 25         # of a worker's table, words by languages: with very many languages it remembers fewer words
UND = "und"

# Country code suffixes and their language.
SUFFIX_LANG = {"at": "de", "de": "de", "es": "es", "fr": "fr", "it": "it", "mx": "es", "nl": "nl",
               "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}

LETTERS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&#?\w{1,32};")


def visible(html: str) -> str:
    return ENTITY.sub(" ", HIDDEN.sub(" ", html))


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i:i + 3] for i in range(len(w) - 2)]


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> dict:
    """Trigram models of the languages labelled in ``docs``, for the driver:
    of each language the trigrams that it has and the logarithm of one more
    than their count, by trigram."""
    labelled = (docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.col(label) != UND))
                .select(F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
                .withColumn("hash", F.xxhash64("key", "text")))
    # choose by hash first, so that no text is sorted or shuffled but the chosen
    part = Window.partitionBy("lang", "part").orderBy("hash")       # parts first: a language may hold most rows
    first = Window.partitionBy("lang").orderBy("hash")
    chosen = (labelled.select("lang", "hash", F.pmod("hash", F.lit(PARTS)).alias("part")).distinct()
              .withColumn("at", F.row_number().over(part)).filter(F.col("at") <= TRAIN_ROWS)
              .withColumn("at", F.row_number().over(first)).filter(F.col("at") <= TRAIN_ROWS)
              .groupBy("lang").agg(F.max("hash").alias("last")))
    last = cut(chosen.select("lang", "last"))     # a row a language
    sample = (labelled.join(F.broadcast(last), "lang").filter(F.col("hash") <= F.col("last"))
              .dropDuplicates(["lang", "hash"]))

    def count(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = seen.setdefault(lang, Counter())
                for w, n in Counter(LETTERS.findall(t.lower())).items():
                    for g in grams(w):
                        c[g] += n
        rows = [(lang, g, n) for lang, c in seen.items() for g, n in c.items()]
        if rows:
            yield pa.record_batch({"lang": pa.array([r[0] for r in rows], pa.string()),
                                   "gram": pa.array([r[1] for r in rows], pa.string()),
                                   "n": pa.array([r[2] for r in rows], pa.int64())})

    counted = (sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    top = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = (counted.withColumn("at", F.row_number().over(top)).filter(F.col("at") <= MAX_GRAMS)
            .select("lang", "gram", "n").toArrow())
    names = rows.column("lang").combine_chunks().dictionary_encode()
    listed = names.dictionary.to_pylist()
    langs = sorted(listed)
    at = np.array([langs.index(x) for x in listed], np.int64)[names.indices.to_numpy()] if langs else np.empty(0, np.int64)
    coded = rows.column("gram").combine_chunks().dictionary_encode()
    gram, n = coded.indices.to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(float)
    by = np.lexsort((at, gram))
    vocab = len(coded.dictionary)
    totals = np.bincount(at, n, len(langs)) + vocab + 1
    return {"langs": langs, "grams": coded.dictionary.to_pylist(), "start": np.searchsorted(gram[by], np.arange(vocab + 1)),
            "lang": at[by].astype(np.int32), "gain": np.log(n[by] + 1), "other": -np.log(totals), "und": float(-np.log(vocab + 1))}


class _Scorer:
    """Sums of word scores; remembers the words that it has met."""

    def __init__(self, model):
        self.n = len(model["langs"]) + 1
        self.place = {g: i for i, g in enumerate(model["grams"], 1)}     # 0: any other trigram
        self.start = np.concatenate([[0], model["start"]])
        self.lang, self.gain = model["lang"], model["gain"]
        self.base = np.array([*model["other"], model["und"]])
        self.part = max(1, min(PART_WORDS, CELLS // 8 // self.n))
        self.cache = max(self.part, min(CACHE_WORDS, CELLS // self.n))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, self.n))

    def learn(self, new: list[str]) -> None:
        """Rows of the table for words without one."""
        at, place = len(self.rows), self.place
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        step = max(1, CELLS // 64 // self.n)
        for i in range(0, len(new), step):
            listed = [grams(w) for w in new[i:i + step]]
            sizes = np.fromiter(map(len, listed), np.int64, len(listed))
            flat = np.array([place.get(g, 0) for gs in listed for g in gs])
            many = self.start[flat + 1] - self.start[flat]
            cell = np.arange(many.sum()) + np.repeat(self.start[flat] - np.cumsum(many) + many, many)
            word = np.repeat(np.repeat(np.arange(len(listed)), sizes), many)
            gain = np.bincount(word * self.n + self.lang[cell], self.gain[cell], len(listed) * self.n)
            self.table[at + i:at + i + len(listed)] = gain.reshape(-1, self.n) + sizes[:, None] * self.base
        self.rows.update(zip(new, range(at, at + len(new))))

    def score(self, text: str) -> np.ndarray | None:
        """Tempered log likelihoods of the languages and of ``und``; None
        where the text has no letters."""
        total, some, found = np.zeros(self.n), False, LETTERS.findall(text.lower())
        for i in range(0, len(found), self.part):
            part = found[i:i + self.part]
            if len(self.rows) + len(part) > self.cache:
                self.rows.clear()
            if new := list(set(part).difference(self.rows)):
                self.learn(new)
            total += self.table[list(map(self.rows.__getitem__, part))].sum(axis=0)
            some = True
        return TEMPER * total if some else None


def soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def identify(rows: DataFrame, model: dict, keep: list[str], text: str = "text", declared: str | None = "declared",
             host: str | None = "host", html: bool = False, suffix: str | None = None) -> DataFrame:
    """``keep`` columns with ``lang``, ``posterior`` and ``accepted``.

    ``declared``, ``host`` and ``suffix`` name the evidence columns; None
    where the table has none."""
    langs = model["langs"]
    n = len(langs) + 1
    sc = rows.sparkSession.sparkContext
    shared, token = sc.broadcast(model), uuid.uuid4().hex
    none = F.lit(None).cast("string")
    base = rows.select(*keep, *[(F.col(c).cast("string") if c else none).alias(a) for c, a in
                                ((declared, "__declared"), (host, "__host"), (suffix, "__suffix"), (text, "__text"))])
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [T.StructField(c, kinds[c]) for c in keep] + [
        T.StructField("__declared", T.StringType()), T.StructField("__host", T.StringType()),
        T.StructField("__suffix", T.StringType()),
        T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__p", T.ArrayType(T.DoubleType()))]

    def likelihoods(batches):
        slot = worker_memo("language", "model", dict)        # one model a worker
        if token not in slot:
            slot.clear()
            slot[token] = _Scorer(shared.value)
        scorer = slot[token]
        for b in batches:
            ll, p = [], []
            for t in texts_of(b.column(b.num_columns - 1)):
                s = scorer.score(visible(t) if html else t) if t else None
                ll.append(None if s is None else s.tolist())
                p.append(None if s is None else soft(s).tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ll, kind), pa.array(p, kind)],
                                             names=[f.name for f in fields])
        give_back()

    seen = cut(base.mapInArrow(likelihoods, T.StructType(fields)))

    # soft counts by host, domain and in all; sums are combined map-side
    domain = F.when(F.col("__host").isNotNull(), F.substring_index("__host", ".", -2)).alias("__domain")
    sums = [F.sum(F.element_at("__p", i + 1)).alias(f"s{i}") for i in range(n)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    by_host = seen.filter("__p is not null and __host is not null").groupBy("__host").agg(*sums).withColumn("__domain", domain)
    by_domain = by_host.groupBy("__domain").agg(*again)
    total = by_domain.agg(*again).first()
    every = np.array([total[f"s{i}"] or 0.0 for i in range(n)])
    every = (every + 1) / (every + 1).sum()

    def smoothed(df, above):
        df = df.withColumn("__count", F.aggregate(F.array(*[f"s{i}" for i in range(n)]), F.lit(0.0), lambda a, x: a + x))
        return df.select("__domain", *[((F.col(f"s{i}") + SMOOTH * above[i]) / (F.col("__count") + SMOOTH)).alias(f"d{i}")
                                       for i in range(n)])

    by_domain = smoothed(by_domain, [F.lit(float(x)) for x in every])
    priors = by_host.join(by_domain, "__domain").select(
        "__host", F.array(*[f"s{i}" for i in range(n)]).alias("__sums"), F.array(*[f"d{i}" for i in range(n)]).alias("__above"))
    priors = priors.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = seen.withColumn("__salt", F.pmod(row_key(*keep), F.lit(SALTS)).cast("int"))   # null hosts too
    joined = salted.join(priors, ["__host", "__salt"], "left")
    names = [c for c in joined.columns if c not in ("__salt", "__p", "__suffix")] + ["__p", "__suffix"]
    joined = joined.select(*names)
    at = {c: i for i, c in enumerate(names)}

    def fuse(batches):
        place = {lang: i for i, lang in enumerate(langs)}

        def evidence(lang, trust):
            x = np.zeros(n)
            if lang in place and n > 2:
                x[:] = np.log((1 - trust) / (n - 2))
                x[place[lang]] = np.log(trust)
                x[-1] = x.mean()            # tells nothing about text that is no language
            return x

        for b in batches:
            get = {c: b.column(at[c]).to_pylist() for c in names if c.startswith("__")}
            lang, top, ok = [], [], []
            for i in range(b.num_rows):
                ll = get["__ll"][i]
                if ll is None:
                    lang.append(UND)
                    top.append(1.0)
                    ok.append(False)
                    continue
                score = np.array(ll) + evidence((get["__declared"][i] or "").strip().lower().split("-")[0], TRUST_DECLARED)
                score += evidence(SUFFIX_LANG.get((get["__suffix"][i] or "").lower()), TRUST_SUFFIX)
                if get["__sums"][i] is not None:
                    rest = np.maximum(np.array(get["__sums"][i]) - np.array(get["__p"][i]), 0)
                    score += np.log((rest + SMOOTH * np.array(get["__above"][i])) / (rest.sum() + SMOOTH))
                else:
                    score += np.log(every)
                p = soft(score)
                best = int(p.argmax())
                lang.append(langs[best] if best < n - 1 else UND)
                top.append(float(p[best]))
                ok.append(n == 1 or (best < n - 1 and p[best] >= ACCEPT))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(at[c]) for c in keep], pa.array(lang, pa.string()), pa.array(top, pa.float64()),
                 pa.array(ok, pa.bool_())], names=[*keep, "lang_id", "posterior", "accepted"])

    return joined.mapInArrow(fuse, T.StructType([T.StructField(c, kinds[c]) for c in keep] + [
        T.StructField("lang_id", T.StringType()), T.StructField("posterior", T.DoubleType()),
        T.StructField("accepted", T.BooleanType())]))


def identify_pages(pages: DataFrame, model: dict) -> DataFrame:
    """Pages: declared language from the markup, suffix and host from the address."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    lang = F.regexp_extract(F.col("html"), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    rows = pages.select("page_id", F.col("html").alias("text"), F.when(lang != "", F.lower(lang)).alias("declared"),
                        host.alias("host"), F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"))
    return identify(rows, model, ["page_id"], html=True, suffix="suffix")


def identify_documents(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Documents: the ``lang`` column declares, the ``source`` is the host."""
    return identify(docs, model, keep, declared="lang", host="source")
