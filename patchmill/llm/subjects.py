"""Subject areas of documents: labels spread from trusted seeds over documents linked through verified terms."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchmill.functions.labels import ZERO_WIDTH
from patchmill.storage import Workspace, bytes_of

BROADCAST_BYTES = 32 << 20


MARKUP = r"</?[\p{L}!][^<>]*>"


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big", signed=True)


def _cut(text: pa.Array, longest: int, run: int) -> pa.Array:
    """The statements of each text as lists of hashed terms. Words are looked at once a batch, all else runs over their codes."""
    t = pc.replace_substring_regex(pc.fill_null(text, ""), ZERO_WIDTH, "")
    t = pc.utf8_lower(pc.replace_substring_regex(t, MARKUP, "\n"))
    t = pc.replace_substring_regex(t, r"[.!?]+(\s|\p{L}|$)", "\n\\1")
    t = pc.replace_substring(pc.replace_substring_regex(t, r"[^\p{L}\p{N}\n]+", " "), "\n", " \n ")
    lists = pc.split_pattern(t, " ")
    off = lists.offsets.to_numpy().astype("int64")
    coded = lists.values.dictionary_encode()
    words = coded.dictionary
    ok = pc.match_substring_regex(words, r"^\p{L}{3,}$").to_numpy(zero_copy_only=False).astype(bool)
    ends = pc.equal(words, "\n").to_numpy(zero_copy_only=False).astype(bool)
    plain = [_hash(w) if o else 0 for w, o in zip(pc.replace_substring_regex(words, "s$", "").to_pylist(), ok.tolist(), strict=True)]
    terms, of_word = np.unique(np.array(plain, dtype="int64"), return_inverse=True)
    code = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), np.diff(off))
    start = np.zeros(len(code), dtype=bool)
    start[off[:-1][np.diff(off) > 0]] = True
    sno = np.cumsum(start | ends[code]) if len(code) else np.zeros(0, dtype="int64")
    keep = ok[code] if len(code) else start
    doc, sno, term = doc[keep], sno[keep], of_word[code[keep]] if len(code) else code
    first = np.flatnonzero(np.diff(sno, prepend=-1)) if len(sno) else np.zeros(0, dtype="int64")
    size = np.diff(np.append(first, len(sno)))
    at = np.arange(len(sno)) - np.repeat(first, size)
    part = np.where(np.repeat(size, size) > longest, at // run, 0)
    new = np.diff(sno, prepend=-1).astype(bool) | np.diff(part, prepend=0).astype(bool)
    st = np.cumsum(new) - 1
    width = max(len(terms), 1)
    pair = np.unique(st * width + term)  # a term counts once a statement
    st_of, term_of = pair // width, pair % width
    doc_of = doc[np.flatnonzero(new)]
    inner = np.append(0, np.cumsum(np.bincount(st_of, minlength=len(doc_of)))).astype("int32")
    outer = np.append(0, np.cumsum(np.bincount(doc_of, minlength=len(lists)))).astype("int32")
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(terms[term_of])))


def statement_terms(docs: DataFrame, longest: int = 24, run: int = 8, step: int = 1000) -> DataFrame:
    """(doc_id, terms): the statements of each text, each as its distinct hashed terms, words of three letters or more without a last s.

    Markup ends a statement, so do line ends and sentence marks before a blank, a letter or the end. Where marks were lost, a statement of
    more than ``longest`` words is taken as statements of ``run`` words each. Letters inside codes and numbers are no words. Statements
    without a term are left out; texts without any, NULL and empty ones have an empty list. Whole texts are read, ``step`` at a time.
    """

    def kernel(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(0, b.num_rows, step):
                c = b.slice(i, step)
                yield pa.RecordBatch.from_arrays([c.column(0), _cut(c.column(1), longest, run)], ["doc_id", "terms"])

    t = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(kernel, f"doc_id {t}, terms array<array<bigint>>")


class _Batch:
    """Documents of a batch: their statements and the terms in these, as flat arrays."""

    def __init__(self, terms: pa.ListArray, seed: pa.ListArray, k: int):
        outer = terms.offsets.to_numpy().astype("int64")
        inner = terms.flatten()
        self.n_docs, self.k = len(terms), k
        self.per_doc = np.diff(outer)
        self.doc = np.repeat(np.arange(self.n_docs), self.per_doc)
        size = np.diff(inner.offsets.to_numpy().astype("int64"))
        self.term = inner.flatten().to_numpy()
        self.st = np.repeat(np.arange(len(inner)), size)
        self.seed = np.zeros((self.n_docs, k))
        at = np.diff(seed.offsets.to_numpy().astype("int64"))
        self.seed[np.repeat(np.arange(self.n_docs), at), seed.flatten().to_numpy()] = 1.0
        self.free = ~self.seed.any(1)

    def judge(self, table: tuple, before: np.ndarray | None, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(y, counts, soft): the subject of each statement or -1, and of each document how many statements are about each subject and their support."""
        keys, logs, marked = table
        p, mark = np.zeros((len(self.doc), self.k)), np.zeros(len(self.doc), dtype=bool)
        if len(keys) and len(self.term):
            at = np.minimum(np.searchsorted(keys, self.term), len(keys) - 1)
            hit = keys[at] == self.term
            at, st = at[hit], self.st[hit]
            if len(at):
                first = np.flatnonzero(np.diff(st, prepend=-1))
                p[st[first]] = 1 - np.exp(np.add.reduceat(logs[at], first))
                mark[st[first]] = np.logical_or.reduceat(marked[at], first)
        weight = 1 + 0.5 * self.seed
        if before is not None:
            total = before.sum(1, keepdims=True)
            weight = weight + np.divide(before, total, out=np.zeros_like(before), where=total > 0)
        y = np.where((p.max(1, initial=0.0) >= strength) & ~mark, (p * weight[self.doc]).argmax(1) if len(p) else 0, -1)
        counts = np.zeros((self.n_docs, self.k))
        np.add.at(counts, (self.doc[y >= 0], y[y >= 0]), 1.0)
        soft = np.stack([np.bincount(self.doc, weights=np.where(mark, 0.0, p[:, i]), minlength=self.n_docs) for i in range(self.k)], 1).astype(float)
        return y, counts, soft

    def seen(self, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, sums): of each term the statements judged, those with company in their document, those that take up a subject from the others, and these by subject."""
        d, got = self.doc, y >= 0
        own = np.zeros((len(d), self.k))
        own[np.flatnonzero(got), y[got]] = 1.0
        other, every = counts[d] - own, counts.sum(1)[d]
        left = every - got
        judged = got & (every >= 3)
        company = judged & ((other * own).sum(1) > 0)
        rest = (self.free[d][:, None] & (other >= 1) & (other >= 0.25 * left[:, None])).astype(float)
        v = np.column_stack([judged, company, rest.any(1), rest]).astype(float)
        use = (v[:, 0] + v[:, 2] > 0)[self.st]
        code, terms = pd.factorize(self.term[use])
        st = self.st[use]
        return terms, np.stack([np.bincount(code, weights=v[st, j], minlength=len(terms)) for j in range(v.shape[1])], 1).astype(float)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table that was written, if its size allows; else it is joined by a shuffle."""
    return F.broadcast(df) if bytes_of(df) < BROADCAST_BYTES else df


def subject_shares(docs: DataFrame, seeds: DataFrame, subjects: list[str], *, rounds: int = 3, trusted: int = 4, strength: float = 0.66, floor: float = 0.35, smoothing: float = 2.0, passing: float = 0.34) -> DataFrame:
    """(doc_id, n_statements, counts, soft): how many statements of each document are about each subject, in the order of subjects.

    docs: doc_id (unique), text; seeds: doc_id, subject. Documents are linked through the terms of their statements, so the graph has
    one edge for each statement and term, never one for each pair of documents. An edge is verified where the term
    tells a subject: the share of its statements whose document has that subject, less one standard error, lies well above the
    share in all statements. Terms with ``trusted`` statements or more in seed documents are clamped to what those say; the
    others take up, round by round, the subjects that the *other* statements of their documents got, so no statement
    confirms itself. A statement gets the subject that its verified terms support best (noisy-or of at least ``strength``), with the
    document's other statements as context; so one document keeps several subjects. Wordings whose statements bring subjects
    that their documents otherwise don't have (``passing``) mention in passing and count for none.

    The join of statements and verified terms looks these up in a table that goes along with the kernel while it is below
    BROADCAST_BYTES, and shuffles both by term beyond it; the rows are the same. Constants: an edge of ``floor`` is verified where a term
    has its subject in over a third more statements than any, ``strength`` takes two such edges or one of two thirds, ``passing`` is a
    third of a wording's statements, ``smoothing`` and ``trusted`` count two and four statements as little evidence. They are round
    shares chosen by hand, not fitted; the README has what was measured with them.
    """
    k = len(subjects)
    if not k:
        raise ValueError("no subjects")
    ws = Workspace(docs.sparkSession, "subjects")
    ix = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])
    lab = ws.cut(seeds.where(F.col("subject").isin(*subjects)).select("doc_id", ix[F.col("subject")].alias("i")).groupBy("doc_id").agg(F.collect_set("i").alias("seed")))
    st = ws.cut(statement_terms(docs).join(_small(lab), "doc_id", "left").withColumn("seed", F.coalesce("seed", F.array().cast("array<int>"))))
    has = lambda c, i: F.array_contains(c, F.lit(i)).cast("double")
    seeded = st.where(F.size("seed") > 0)
    base_row = seeded.agg(F.sum(F.size("terms")).alias("n"), *[F.sum(has("seed", i) * F.size("terms")).alias(f"b{i}") for i in range(k)]).first()
    base = [min((base_row[f"b{i}"] or 0.0) / base_row["n"] if base_row["n"] else 0.0, 0.99) for i in range(k)]
    own = seeded.select("seed", F.explode(F.flatten("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n0"), *[F.sum(has("seed", i)).alias(f"s{i}") for i in range(k)])
    own = ws.cut(own)

    def told(n: Column, s: list[Column]) -> Column:
        """Support of each subject beyond its base share, by the lower bound of the smoothed share."""
        out = []
        for i in range(k):
            m = (s[i] + smoothing * base[i]) / (n + smoothing)
            low = m - F.sqrt(m * (1 - m) / (n + smoothing))
            x = (low - base[i]) / (1 - base[i])
            out.append(F.when(x >= floor, F.least(x, F.lit(0.999))).otherwise(0.0))
        return F.array(*out)

    def run(step: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
        """All rounds, each by step(terms, last): statistics of terms or, in the last round, of documents."""
        verified = own.select("term", told(F.col("n0"), [F.col(f"s{i}") for i in range(k)]).alias("e")).where(F.array_max("e") > 0)
        marks = None
        for r in range(rounds):
            terms = verified.withColumn("mark", F.lit(False))
            if marks is not None:
                terms = terms.join(marks, "term", "full").select("term", F.coalesce("e", F.array(*[F.lit(0.0)] * k)).alias("e"), F.coalesce(F.col("marked"), F.col("mark")).alias("mark"))
            out = step(ws.cut(terms), r == rounds - 1)
            if r == rounds - 1:
                return out
            seen = ws.cut(out)
            found = seen.where((F.col("wn") >= 4) & ((F.col("wk") + 1) / (F.col("wn") + 2) < passing)).select("term", F.lit(True).alias("marked"))
            marks = ws.cut(found if marks is None else marks.unionByName(found).distinct())
            j = own.join(seen, "term", "full").na.fill(0.0)
            part = F.when(F.col("n0") >= trusted, 0.0).otherwise(1.0)
            verified = j.select("term", told(F.col("n0") + part * F.col("n1"), [F.col(f"s{i}") + part * F.col(f"r{i}") for i in range(k)]).alias("e")).where(F.array_max("e") > 0)

    try:
        return run(_by_lookup(st, k, strength))
    except _TooLarge:
        return run(_by_joins(ws, st, k, strength))


class _TooLarge(Exception):
    """A table of terms is above the bound of what goes along with a kernel."""


def _by_lookup(st: DataFrame, k: int, strength: float) -> Callable[[DataFrame, bool], DataFrame]:
    """Rounds over batches of documents that look terms up in tables; the tables of earlier rounds give each document its earlier subjects again."""
    tables, context = [], st.sparkSession.sparkContext
    t = st.schema["doc_id"].dataType.simpleString()

    def step(terms: DataFrame, last: bool) -> DataFrame:
        if terms.count() * (8 * k + 9) > BROADCAST_BYTES:
            raise _TooLarge
        rows = terms.select("term", *[F.col("e")[i].alias(f"e{i}") for i in range(k)], "mark").orderBy("term").toPandas()
        tables.append(context.broadcast((rows["term"].to_numpy(dtype="int64"), np.log1p(-rows[[f"e{i}" for i in range(k)]].to_numpy(dtype=float)), rows["mark"].to_numpy(dtype=bool))))
        known = list(tables)

        def kernel(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                x, y, counts, soft = _Batch(b.column(1), b.column(2), k), None, None, None
                for table in known:
                    y, counts, soft = x.judge(table.value, counts, strength)
                if last:
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * k + 1, k, dtype="int32")), pa.array(v.ravel())) for v in (counts, soft)]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.per_doc.astype("int64")), *lists], ["doc_id", "n_statements", "counts", "soft"])
                else:
                    seen, sums = x.seen(y, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(sums[:, j]) for j in range(k + 3)]], names)

        names = ["term", "wn", "wk", "n1", *[f"r{i}" for i in range(k)]]
        if last:
            out = st.select("doc_id", "terms", "seed").mapInArrow(kernel, f"doc_id {t}, n_statements long, counts array<double>, soft array<double>")
            return out.where("n_statements > 0")
        part = st.select("doc_id", "terms", "seed").mapInArrow(kernel, ", ".join(f"{n} {'long' if n == 'term' else 'double'}" for n in names))
        return part.groupBy("term").agg(*[F.sum(n).alias(n) for n in names[1:]])

    return step


def _by_joins(ws: Workspace, st: DataFrame, k: int, strength: float) -> Callable[[DataFrame, bool], DataFrame]:
    """The same rounds by joins of statements and terms, for tables of terms of any size."""
    each = ws.cut(st.select("doc_id", "seed", F.posexplode("terms").alias("sno", "terms")))
    pairs = each.select("doc_id", "sno", F.explode("terms").alias("term"))
    state = [None]
    one = lambda i: F.array_contains("seed", F.lit(i)).cast("double")

    def step(terms: DataFrame, last: bool) -> DataFrame:
        nor = [(1 - F.exp(F.sum(F.log1p(-F.col("e")[i])))).alias(f"p{i}") for i in range(k)]
        scored = pairs.join(terms, "term").groupBy("doc_id", "sno").agg(F.max("mark").alias("mark"), *nor)
        scored = each.select("doc_id", "sno", "seed").join(scored.select("doc_id", "sno", "mark", F.array(*[f"p{i}" for i in range(k)]).alias("p")), ["doc_id", "sno"], "left")
        scored = scored.withColumns({"mark": F.coalesce("mark", F.lit(False)), "p": F.coalesce("p", F.array(*[F.lit(0.0)] * k))})
        before = F.lit(None).cast("array<double>")
        if state[0] is not None:
            scored, before = scored.join(state[0].select("doc_id", F.col("counts").alias("before")), "doc_id", "left"), F.col("before")
        total = F.aggregate(before, F.lit(0.0), lambda a, x: a + x)
        weight = [F.col("p")[i] * (1 + 0.5 * one(i) + F.coalesce(F.try_divide(before[i], total), F.lit(0.0))) for i in range(k)]
        scored = scored.withColumn("w", F.array(*weight)).withColumn("y", F.when((F.array_max("p") >= strength) & ~F.col("mark"), F.array_position("w", F.array_max("w")).cast("int") - 1))
        scored = ws.cut(scored.select("doc_id", "sno", "mark", "p", "y"))
        state[0] = ws.cut(scored.groupBy("doc_id").agg(
            F.count("*").alias("n_statements"),
            F.array(*[F.sum(F.when(F.col("y") == i, 1.0).otherwise(0.0)) for i in range(k)]).alias("counts"),
            F.array(*[F.sum(F.when(~F.col("mark"), F.col("p")[i]).otherwise(0.0)) for i in range(k)]).alias("soft"),
        ))
        if last:
            return state[0]
        x = each.join(scored.select("doc_id", "sno", "y"), ["doc_id", "sno"]).join(state[0].select("doc_id", F.col("counts").alias("c")), "doc_id").withColumn("all", F.aggregate("c", F.lit(0.0), lambda a, v: a + v))
        other = [F.col("c")[i] - F.when(F.col("y") == i, 1.0).otherwise(0.0) for i in range(k)]
        x = x.withColumn("o", F.array(*other)).withColumn("left", F.col("all") - F.when(F.col("y").isNotNull(), 1.0).otherwise(0.0))
        judged = F.col("y").isNotNull() & (F.col("all") >= 3)
        rest = [F.when((F.size("seed") == 0) & (F.col("o")[i] >= 1) & (F.col("o")[i] >= 0.25 * F.col("left")), 1.0).otherwise(0.0) for i in range(k)]
        x = x.select(F.explode("terms").alias("term"), judged.cast("double").alias("wn"), F.when(judged & (F.col("o")[F.col("y")] > 0), 1.0).otherwise(0.0).alias("wk"), F.array(*rest).alias("rest"))
        return x.groupBy("term").agg(F.sum("wn").alias("wn"), F.sum("wk").alias("wk"), F.sum((F.array_max("rest") > 0).cast("double")).alias("n1"), *[F.sum(F.col("rest")[i]).alias(f"r{i}") for i in range(k)])

    return step


def document_subjects(docs: DataFrame, seeds: DataFrame, subjects: list[str], *, share: float = 0.2, most: int = 3, every: bool = False, **how) -> DataFrame:
    """(doc_id, subject, share): one to ``most`` subjects of each document that has any words, with every also of those that have none.

    A subject is a document's where at least ``share`` of its statements are about it; where none reaches that, the one with the most
    statements or, failing these, the most support is. Documents without any support get the subject most common in the corpus.
    Documents without words get their seed subjects, else the most common one, with share 0.
    """
    k = len(subjects)
    ws = Workspace(docs.sparkSession, "areas")
    t = ws.cut(subject_shares(docs, seeds, subjects, **how))
    common = t.agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(k)]).first()
    usual = max(range(k), key=lambda i: (common[f"c{i}"] or 0.0, -i))
    one = F.array(*[F.struct((F.col("counts")[i] / F.col("n_statements")).alias("share"), (F.col("soft")[i] + (F.lit(1e-9) if i == usual else F.lit(0.0))).alias("soft"), F.lit(-i).alias("o"), F.lit(s).alias("subject")) for i, s in enumerate(subjects)])
    ranked = F.sort_array(one, False)
    x = t.select("doc_id", ranked.alias("r"))
    enough = F.filter(F.slice("r", 1, most), lambda s: s["share"] >= share - 1e-9)
    x = x.select("doc_id", F.explode(F.when(F.size(enough) > 0, enough).otherwise(F.slice("r", 1, 1))).alias("s"))
    x = x.select("doc_id", "s.subject", "s.share")
    if not every:
        return x
    own = seeds.where(F.col("subject").isin(*subjects)).groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("subject")), 1, most).alias("own"))
    bare = docs.where("doc_id is not null").select("doc_id").join(t.select("doc_id"), "doc_id", "left_anti").join(own, "doc_id", "left")
    return x.unionByName(bare.select("doc_id", F.explode(F.coalesce("own", F.array(F.lit(subjects[usual])))).alias("subject"), F.lit(0.0).alias("share")))
