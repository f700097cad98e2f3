"""Whitening, fill-in-middle and license scans against brute force on small tables that hold the odd cases of each."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ROWS, SCHEMA

from codecensus.llm import common, fill_in_middle, licenses, whitening

BLANK, WORD = "[\x20\x09-\x0d]", "[^\x20\x09-\x0d]"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"


def texts():
    rng = random.Random(3)
    out = [r[1] for r in ROWS]
    out += ["a <P> b c d e f", "x <S>", "<M>", "<", "<P", "a < P> b S> <M c", "  ", "\n", " a", "a ", "  a b", "é" * 200_000 + " x", "word " * 60_000]
    out += ["".join(rng.choice(["a", "<", "P", ">", " ", "\n", "ß", "😀"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    out += [MIT, MIT.replace("granted", "given"), MIT + "\n\n" + NO_WARRANTY, "see " + MIT + " " + NO_WARRANTY.replace("TORT", "TORTS"), MIT + " " + MIT,
            NO_WARRANTY, GPL, GPL + ", either version 3 of the License, or any later version.", GPL.replace("program", "very long name of a program"),
            "The MIT License", "mit", "MIT-License apache license, General Public\nLicense mit license", "general mit license public license",
            "éMIT License", "MIT License2", "SPDX-License-Identifier: MIT", "Licensed under CC BY-NC 4.0.", "licensed under the MIT license licensed under the CC BY 4.0",
            "permission " * 500 + MIT, GPL + " " + GPL[:60] + " " + GPL, "word " * 300_000 + "mit license " + MIT]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    spark.conf.set("spark.sql.caseSensitive", "true")
    rows = [(i, t, "en", "hot", None, 7, "k", "s", "clash", 1) for i, t in enumerate(texts())]
    rows += [(None, None, None, None, None, None, None, None, None, None)] * 40 + [rows[14]] * 9 + [(5, "other text under one id", "en", "s", 1, 1, "", "", "", 1)] * 2
    rows += [(-7, "negative id, five words", None, None, 1, 1, "", "", "", 1), (2**62, "large id in words", None, None, 1, 1, "", "", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    yield common.saved(df.toDF(*df.columns), "odd-three")
    spark.conf.set("spark.sql.caseSensitive", "false")


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def fim(doc_id, text):
    t = text or ""
    units = re.findall(f"{BLANK}*{WORD}+|{BLANK}+", t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:z], units[z:]))
    sha = hashlib.sha256(t.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha, sha
    spm = h4 % 100 < 80
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), hashlib.sha256(out.encode()).hexdigest(), sha


def test_fill_in_middle(docs, monkeypatch):
    want = sorted((fim(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert as_set(fill_in_middle.fill_in_middle(docs).collect()) == want
    # the pieces themselves give the output
    parts = {}
    for r in fill_in_middle.pieces(docs.filter("doc_id = 76")).collect():
        parts[r.pos] = bytes(r.data)
    assert hashlib.sha256(b"".join(parts[k] for k in sorted(parts))).hexdigest() == next(w for w in want if w[0] == 76)[5]


def test_fill_in_middle_in_small_pieces(spark, docs, monkeypatch):
    """Many pieces a document, cut inside long units, and many batches give the same rows as one piece a section."""
    monkeypatch.setattr(fill_in_middle, "PIECE", 8)
    monkeypatch.setattr(fill_in_middle, "FLUSH_ROWS", 7)
    import pyarrow as pa
    for doc_id, text in ((76, "one two  three ééééééééééééé 😀😀😀😀😀 x"), (3, "a b c"), (8, "w " * 50), (11, "abcdefghijklmnop" * 9)):
        for form in range(3):
            h = (5, 2, 99 if form == 0 else 0, 0 if form == 1 else 99)
            b = common.batch(doc_id=pa.array([doc_id] * 2, pa.int64()), text=pa.array([text, text]), **{f"h{k + 1}": pa.array([h[k]] * 2, pa.int64()) for k in range(4)})
            cut = pa.Table.from_batches(list(fill_in_middle.cut([b]))).sort_by([("key", "ascending"), ("pos", "ascending")])
            assert all(len(x.as_py()) <= 8 + 3 for x in cut["data"]) and all(x.as_py().decode() is not None for x in cut["data"])
            put = pa.Table.from_batches(list(fill_in_middle.assemble(cut.to_batches(max_chunksize=3))))
            put = put.sort_by([("key", "ascending"), ("place", "ascending"), ("pos", "ascending")])
            back = pa.Table.from_batches(list(fill_in_middle.restore(put.to_batches(max_chunksize=2)))).to_pylist()
            assert [r["restored_sha256"] for r in back] == [hashlib.sha256(text.encode()).hexdigest()] * 2


def test_fill_in_middle_on_nothing(docs):
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def pattern(markup):
    """A template as a regular expression over words with a blank behind each."""
    out = ""
    for kind, least, most, text in re.findall(r"<<(optional|end|var)(?: (\d+) (\d+))?>>|([^<]+|<)", markup):
        out += {"optional": "(?:", "end": ")?", "var": rf"(?:\S+ ){{{least},{most}}}"}.get(kind, "".join(re.escape(w) + " " for w in re.findall("[0-9a-z]+", text.lower())))
    return re.compile(r"(?<!\S)" + out)


def scanned(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, i + len(p), label) for p, label in ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
              for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
    line = "".join(w + " " for w in words)
    found = []
    for label, markup in licenses.TEMPLATES:
        for m in pattern(markup).finditer(line):
            a, z = line.count(" ", 0, m.start()), line.count(" ", 0, m.end())
            found.append((a, z, label))
    cover = {i for a, z, _ in places + found for i in range(a, z)}
    starts = [a for a, _, _ in places]
    names = {x for *_, x in places}
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
            ",".join(sorted(names | {x for *_, x in found})), len(cover) / len(words) if words else 0.0)


def test_license_scan(docs):
    rows = docs.select("doc_id", "text").collect()
    got = licenses.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert as_set(got) == sorted(((r.doc_id, *scanned(r.text)) for r in rows), key=repr)
    by_text = {t: scanned(t) for t in texts() if t}
    assert by_text[MIT][5] == "mit" and by_text[MIT][4] == "" and by_text[MIT][6] == 1.0
    assert by_text[MIT.replace("granted", "given")][5] == ""
    assert by_text[GPL][5] == "gpl" and by_text[GPL.replace("program", "very long name of a program")][5] == "gpl"  # the phrase itself
    assert by_text["Licensed under CC BY-NC 4.0."][5] == "creative-commons"
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_words_across_segments(monkeypatch):
    whole = licenses.Scanner().scan((MIT + " the MIT license " + NO_WARRANTY).encode())
    monkeypatch.setattr(licenses, "SEGMENT", 9)
    monkeypatch.setattr(licenses, "STATES", 5)
    assert licenses.Scanner().scan((MIT + " the MIT license " + NO_WARRANTY).encode()) == whole
    assert [x for *_, x in whole[2]] == ["mit"]


def test_every_template_accepts_its_own_wording():
    for label, markup in licenses.TEMPLATES:
        for drop in (False, True):
            t = re.sub(r"<<var (\d+) \d+>>", lambda m: " ".join(["2"] * int(m.group(1))) or "", markup)
            while drop and "<<optional>>" in t:
                t = re.sub(r"<<optional>>[^<]*<<end>>", " ", t)
            t = re.sub("<<(optional|end)>>", " ", t)
            assert label in {x for *_, x in licenses.Scanner().scan(t.encode())[2]}, (label, t)


VECTORS = "vec_id long, embedding array<float>, label int, n string, component string, x int"


@pytest.fixture(scope="module")
def vectors(spark):
    common.prepare(spark)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 24)) @ np.diag(np.linspace(2, 0.1, 24)) + 0.3
    rows = [(i, [float(v) for v in np.float32(x)], i % 3, "n", "c", 1) for i, x in enumerate(base)]
    odd = [(1000, None), (1001, []), (1002, [None] + [0.0] * 23), (1003, [float("nan")] + [0.0] * 23), (1004, [float("inf")] + [0.0] * 23),
           (1005, rows[3][1]), (1006, [0.0] * 24), (1007, [-0.0] * 24), (None, rows[4][1]), (3, rows[3][1]), (1008, [1.0, 2.0]), (1009, [3.5, -2.0]), (1010, [1.0, 7.0]), (1011, [5.0])]
    rows += [(i, v, None, None, None, None) for i, v in odd]
    return spark.createDataFrame(rows * 2, VECTORS).repartition(4)


def brute(rows):
    """Exact integers, covariance by fractions, eigenvectors of the dense matrix."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    out = []
    for d in {len(x) for _, x in good}:
        mine = [(i, x) for i, x in good if len(x) == d]
        fit = sorted({tuple(x) for _, x in mine})
        n = len(fit)
        s = [sum(c) for c in zip(*fit, strict=True)]
        v = np.array([[float(sum((Fraction(x[a]) - Fraction(s[a], n)) * (Fraction(x[b]) - Fraction(s[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
        e, w = np.linalg.eigh(v)
        out.append((d, n, s, e[::-1], w[:, ::-1], v, mine))
    return out


def test_whitening(spark, vectors):
    rows = vectors.filter("vec_id < 60 or vec_id is null or vec_id >= 1000")
    usable = [(r.vec_id, r.embedding) for r in rows.collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    got = whitening.whiten(rows).collect()
    want = brute(usable)
    assert len(got) == sum(len(mine) * int((e[:16] > 1e-13 * e[0]).sum()) for _, _, _, e, _, _, mine in want if e[0] > 0)
    keyed = {}
    for r in got:
        keyed.setdefault((r.vec_id, r.n), {})[r.component] = r
    signs = {}
    for d, n, s, e, w, v, mine in want:
        for i, x in mine:
            if d == 1:
                continue
            for k in range(min(d, 16)):
                r = keyed[(i, n)][k + 1]
                assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
                exact = float((np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s, strict=True)]) @ w[:, k]) / math.sqrt(e[k]))
                sign = signs.setdefault((d, k), 1.0 if r.whitened * exact >= 0 else -1.0)
                assert abs(r.whitened - sign * exact) < 1e-9
                assert abs(r.explained / (e[k] / np.trace(v)) - 1) < 1e-12 and r.identity_error < 1e-9


def test_whitening_same_for_any_partitions(spark, vectors):
    a, b = (as_set(whitening.whiten(vectors.repartition(k)).select("vec_id", "component", "n", "deviation", F.round("whitened", 9).alias("w"), "explained").collect()) for k in (1, 7))
    assert a == b


def test_whitening_odd_tables(spark, vectors):
    assert whitening.whiten(vectors.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "", "", 1)] * 3, VECTORS)
    assert whitening.whiten(one).count() == 0  # no spread, no component
    far = spark.createDataFrame([(k, [float(v) for v in x], 1, "", "", 1) for k, x in enumerate([(1e12, 0), (-1e12, 5), (3e12, 1), (1e38, 1)])], VECTORS)
    got = whitening.whiten(far).collect()
    assert {r.vec_id for r in got} == {0, 1, 2}
    assert all(r.deviation is None for r in got if r.vec_id) and all(abs(r.identity_error) < 1e-9 for r in got)


@pytest.mark.parametrize("kind", ["random", "clustered", "repeated", "diagonal", "rank"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(9)
    n, k = 40, 16
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    e = {"random": rng.uniform(0, 9, n), "clustered": np.r_[5 + 1e-9 * np.arange(8), rng.uniform(0, 1, n - 8)], "repeated": np.r_[[7.0] * 5, [3.0] * 12, [1.0] * (n - 17)],
         "diagonal": np.arange(n, dtype=float), "rank": np.r_[rng.uniform(1, 2, 6), np.zeros(n - 6)]}[kind]
    a = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigen(a, k)
    assert np.allclose(values, np.sort(e)[::-1][:k], atol=1e-12 * max(1, e.max()))
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(1, e.max())
