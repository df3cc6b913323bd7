"""Operator 13."""

import hashlib
import random

import numpy as np

from emberlane.llm import suffixes


def by_hand(docs):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, b in texts:
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            least[s] = i if i is not None and (least.get(s) is None or i < least[s]) else least.get(s)
    rows = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            first = least[b[p:p + 50]]
            if i is not None and first is not None and first < i:
                gone[p:p + 50] = True
        edges = np.diff(np.concatenate(([False], gone, [False])).astype(int))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)).tolist()))
        rows.append((i, len(b), tuple(spans), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in df.collect()), key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé漢") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(5, 40))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=rnd.randint(1, 20))) for _ in range(rnd.randint(1, 5))]
        text = " ".join(parts)
        at = rnd.randrange(len(text))
        texts.append(text[:at] + rnd.choice(["", "Z", "ZZ"]) + text[at + 1:])
    return texts


def test_op13_brute_force(spark, monkeypatch):
    texts = corpus(13, 250)
    docs = [(rnd_id, t) for rnd_id, t in zip(random.Random(2).sample(range(-500, 500), len(texts)), texts)]
    docs += [(2000, None), (2001, ""), (2002, "x" * 49), (2003, "x" * 50), (2004, "x" * 3000), (2005, "ab" * 900), (2006, "y" + "ab" * 500), (None, texts[0]), (2007, texts[0]), (2007, texts[0]), (2008, texts[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as kept", "1 as pack", "2 as bucket")
    want = by_hand(docs)
    assert rows_of(suffixes.repeated_passages(df)) == want


def test_op13_hot_grams_and_small_packs(spark):
    """A text whose suffixes are dealt out one by one gives the same, as do packs of one document."""
    texts = corpus(14, 60) + ["common opening of all " + t for t in corpus(15, 60)]
    packs = []
    for i, t in enumerate(texts):
        b = t.encode()
        packs.append(suffixes.Pack(np.array([i], "<i8").tobytes(), np.array([0, len(b)], "<i8").tobytes(), b, 4))
    want = {i: k for i, _, _, k in by_hand(list(enumerate(texts)))}
    for code in (1, 2):
        import pyarrow as pa

        sent, parts = [], []
        for i, own in enumerate(packs):
            entries, first, count, entry = own.shared(np.full(len(own.slots), code, np.uint8))
            parts.append(entries)
            for b, x, y in suffixes._cut(np.array([e[0] for e in entries], np.int64)):
                part = entries[x:y]
                sent.append({"bucket": b, "pack": i, "low": np.array([e[1] for e in part], "<u4").tobytes(), "docs": np.array([e[3] for e in part], "<i8").tobytes(), "sizes": np.array([len(e[2]) for e in part], "<u4").tobytes(), "texts": b"".join(e[2] for e in part)})
        answers = {}
        for bucket in range(4):
            rows = [r for r in sent if r["bucket"] == bucket]
            if rows:
                for r in suffixes._refine(pa.Table.from_pylist(rows)).to_pylist():
                    answers.setdefault(r["pack"], []).append({"bucket": r["bucket"], "answer": r["answer"]})
        for i, own in enumerate(packs):
            marks = suffixes.repeated_starts(own, np.full(len(own.slots), code, np.uint8), suffixes._answered(answers.get(i), "<u8"))
            gone = np.zeros(len(own.text), bool)
            for p in np.flatnonzero(marks):
                gone[p:p + 50] = True
            assert np.frombuffer(own.text, np.uint8)[~gone].tobytes() == want[i]


def test_suffix_classes():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(50, 90))).encode() for _ in range(30)] + [b"a" * 113, b"ab" * 40]
    texts += [t[:60] for t in texts if len(t) >= 60]
    own = [t[p:p + 50] for t in texts for p in range(len(t) - 49)]
    got = suffixes.suffix_classes(texts).tolist()
    of = {}
    assert len(got) == len(own) and all(of.setdefault(s, c) == c for s, c in zip(own, got)) and len(set(of.values())) == len(of)


def test_op13_odd_rows(spark, odd_docs, no_docs):
    rows = suffixes.repeated_passages(odd_docs)
    assert rows.count() == odd_docs.count()
    assert suffixes.repeated_passages(no_docs).count() == 0


def test_digest_columns(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: (n, sum(k for _, k in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in by_hand([(i, b.decode()) for i, b in docs.items()])}
    got = suffixes.op13_suffix_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_op13_text_is_sent_once_however_many_copies():
    """Six copies of a pack send no more text than two."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [t.encode() for t in corpus(16, 40)]
    bounds = np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes()

    def through(step, work, columns):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[str(i) for i in range(len(columns))])
        rows, answers = pa.Table.from_batches(step(4)(iter([batch]))), {}
        for bucket in range(4):
            for r in work(rows.filter(pc.equal(rows["bucket"], bucket))).to_pylist():
                answers.setdefault(r["pack"], []).append({"bucket": r["bucket"], "answer": r["answer"]})
        return rows, [answers.get(p) for p in columns[0]]

    def sent(copies):
        packs = [list(range(copies)), [(np.arange(len(texts)) + c * len(texts)).astype("<i8").tobytes() for c in range(copies)], [bounds] * copies, [b"".join(texts)] * copies]
        _, codes = through(suffixes._post, suffixes._meet, packs)
        _, kinds = through(suffixes._tell, suffixes._sort_out, [*packs, codes])
        rows, _ = through(suffixes._send, suffixes._refine, [*packs, codes, kinds])
        return sum(map(len, rows["texts"].to_pylist()))

    assert 0 < sent(6) == sent(2)


def test_op13_leaves_no_shuffle_files_on_the_way(spark):
    """What was shuffled before the last step is gone when that begins."""
    import os

    dirs = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p: os.path.getsize(p) for d in dirs for at, _, names in os.walk(d) for n in names if n.startswith("shuffle_") for p in [os.path.join(at, n)]}
    texts = corpus(17, 400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled()
    found = suffixes.repeated_passages(df)
    left = sum(n for p, n in shuffled().items() if p not in before)
    assert left < sum(map(len, texts)) // 10
    assert found.count() == len(texts)
