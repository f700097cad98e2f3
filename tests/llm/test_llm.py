"""The training-text operators against brute force on a small table that holds the odd cases of each."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecensus.llm import common, embeddings, katz, language_id, minhash, mixing, pii, quality, rules, sentencepiece_viterbi, token_counts

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, score string, `TEXT` string, `a.b` int"


def prose(rng, n):
    return " ".join(rng.choice("the of and a to in house river green quiet walks sees old stone bread light over under never".split())
                    + rng.choice(["", "", ".", ",", "s", "ing"]) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    base = prose(rng, 300).split()
    texts = [None, "", " \n\t ", "one", "two words", "Ünï cödé ﬁ 😀   x", "<|endoftext|> and <|endoftext|>", "  lead  and   run \n\n  x ",
             "mail a.b@c.de ip 10.0.0.300 or 10.2.3.4 card 4111 1111 1111 1111 tel +49 (30) 1234567", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x',
             "line\nline\nother\nline", "a b c a b c a b c", "x" * 3000, prose(rng, 4000), " ".join(base), " ".join(base).upper()]
    for k in range(60):  # copies of one text with a word or two changed
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [prose(rng, rng.randint(5, 200)) for _ in range(40)]
    texts += [prose(rng, 30) + "### " + " ".join(f"{rng.choice('abc')}%%% X!!" for _ in range(60)) for _ in range(6)]
    rows = [(100 + i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "hot", "hot"][i % 5], None, 7, "k", "s", "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[14], rows[20], (None, "no id here", "en", "s1", 1, 1, "", "", "", 1), (None, None, None, None, None, None, None, None, None, None)]
    return rows


ROWS = odd_rows()


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    yield common.saved(df.toDF(*df.columns), "odd")
    spark.conf.set("spark.sql.caseSensitive", "false")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def got(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in ROWS:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 1024)] += 1
    assert got(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, path).count() == 0
    count, rng = token_counts.counter(token_counts.Vocabulary(path)), random.Random(2)
    for _ in range(2000):
        s = "".join(rng.choice(["a", "aa", " ", "  ", "\n", "\t", "'s", "é", "日", " ", "\x1c", "1", "²", "!", "<|endoftext|>", " "]) for _ in range(rng.randint(0, 12)))
        assert count([s])[0] == len(lib.encode(s, add_special_tokens=False).ids), repr(s)


def test_viterbi_is_optimal_and_round_trips(docs, empty):
    path = P.path("piece_bpe_32k.model")
    p = sentencepiece_viterbi.Pieces(path)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = {p.text[i]: sp.get_score(i) for i in range(len(p.text)) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}

    def best(s):
        score = [0.0] + [None] * len(s)
        for e in range(1, len(s) + 1):
            cands = [score[b] + piece[s[b:e]] for b in range(max(0, e - 16), e) if s[b:e] in piece] + [score[e - 1] + p.lowest]
            score[e] = max(cands)
        return score[-1]

    for s in ("▁the▁house", "▁quiet▁▁river", "aé😀b", "▁​x①", "▁" * 9):
        ids = p.viterbi(s)
        gained = sum(piece[p.text[i]] for i in ids if i not in p.byte_of)
        unknown = sum(1 for c in s if c not in piece)
        assert abs(gained + unknown * p.lowest - best(s)) < 1e-3
    out = sentencepiece_viterbi.encoded(docs, path).collect()
    assert len(out) == len(ROWS) and all(r.round_trip and r.n_pieces == len(r.ids) for r in out)
    assert all(hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256 for r in out)
    assert {r.n_pieces for r in out if r.doc_id in (100, 101)} == {0}
    assert sentencepiece_viterbi.encoded(empty, path).count() == 0


def test_language_code_lengths_and_odd_texts(spark, docs, empty):
    rng = random.Random(1)
    en, fr = "the of and thing house".split(), "le du été çà maison".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(40)), "en" if i % 2 else "fr") for i in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"]
    counts = collections.Counter()
    for _, t, lang in rows:
        d = t.encode()
        for k in range(language_id.ORDER + 1):
            for e in range(k, len(d)):
                counts[lang, d[e - k:e + 1]] += 1

    def bits(lang, d):
        def cost(g):
            seen = {s: c for (x, s), c in counts.items() if x == lang and len(s) == len(g) and s[:-1] == g[:-1]}
            n, k = sum(seen.values()), len(seen)
            if g in seen:
                return np.log2((n + k) / seen[g])
            return (np.log2((n + k) / k) if k else 0) + (cost(g[1:]) if len(g) > 1 else 8)
        return sum(cost(d[max(0, e - language_id.ORDER):e + 1]) for e in range(len(d)))

    for t in ("the house of ça", "maison", "zz", "é"):
        assert np.allclose(model.bits(t.encode()), [bits(x, t.encode()) for x in model.langs], rtol=1e-5)
    src = common.pick(docs, "doc_id", "text")
    out = {r.doc_id: r for r in language_id.predict(src, model).collect()}
    assert out[100].lang_pred == out[101].lang_pred == out[102].lang_pred == "und" and out[103].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.train(common.pick(empty, "doc_id", "text", "lang")) is None
    assert {r.lang_pred for r in language_id.predict(src, None).collect()} == {"und"}


def brute_rules(t):
    w = words(t)
    win = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if win[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, empty):
    want = collections.Counter()
    for r in ROWS:
        s = brute_rules(r[1])
        want[(r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    out = rules.quality_rules(docs)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not (r.base_failed and r.kept) for r in out.collect())
    assert rules.quality_rules(empty).count() == 0


def test_distrusted_host_keeps_only_documents_without_failures(spark):
    rng = random.Random(3)
    text = prose(rng, 80)
    rows = [(i, "short", "bad") for i in range(200)] + [(900, text, "bad"), (901, text + " %%%%" * 30, "bad"), (902, text + " %%%%" * 30, "good")]
    rows += [(1000 + i, prose(rng, 90), "good") for i in range(100)] + [(2000 + i, prose(rng, 90), f"h{i % 9}") for i in range(90)]
    out = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[900] and not out[901] and out[902] and out[1000] and not out[0]


def test_mixing_meets_targets(docs, empty):
    rows = mixing.sizes(docs)
    mix = mixing.plan(rows.select("source", "key", "size"))
    out = mixing.drawn(rows, mix).collect()
    assert len(out) == len(ROWS)
    assert collections.Counter((r.doc_id, r["size"]) for r in out) == collections.Counter((x[0], len(words(x[1]))) for x in ROWS)
    size = collections.Counter()
    for x in ROWS:
        size[x[3]] += len(words(x[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, stopped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in stopped)
        rate = left / sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and rate * weight[s] > 2 * size[s]}
        if not over:
            break
        stopped |= over
    want = {s: 2.0 * size[s] if s in stopped else rate * weight[s] for s in names}
    for r in mix.sources.collect():
        assert abs(r.target - want[r.source]) < 1e-6
        taken = sum(x["size"] * len(x.shards) for x in out if x.source == r.source)
        assert r.target - 60 <= taken <= r.target + 1e-6
    assert all(len(r.shards) <= 2 for r in out)
    again = mixing.drawn(rows, mixing.plan(rows.select("source", "key", "size"))).collect()
    key = lambda rs: sorted((r.doc_id or 0, r["size"], tuple(r.shards)) for r in rs)
    assert key(again) == key(out)
    full = mixing.mixed(docs)
    assert full.columns == docs.columns
    assert full.count() == sum(len(r.shards) for r in out)
    assert mixing.mixed(empty).count() == 0


def test_mixing_fills_a_source_behind_a_long_document(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1500)
    rng = random.Random(12)
    words_of = lambda i, n: " ".join(f"w{i}" for _ in range(n))
    rows = [(i, words_of(i, rng.randint(3, 12)), "abc"[i % 3]) for i in range(900)]
    rows += [(1000 + i, words_of(i, 900), "abc"[i % 3]) for i in range(6)] + [(2000, words_of(1, 9), "b")] * 5 + [(2000, words_of(1, 9), "c")]
    src = mixing.sizes(common.saved(spark.createDataFrame(rows, "doc_id long, text string, source string"), "giants"))
    short = 0
    for seed in range(2):
        mix = mixing.plan(src.select("source", "key", "size"), seed)
        out = mixing.drawn(src, mix).collect()
        assert len(out) == len(rows)
        draws = mix.draws.collect()
        assert len({(d.source, d.block, d["pass"]) for d in draws}) == len(draws)
        for r in mix.sources.collect():
            mine = [x for x in out if x.source == r.source]
            taken = sum(x["size"] * len(x.shards) for x in mine)
            left = collections.Counter()
            for x in mine:
                if len(x.shards) <= r.whole:
                    assert len(x.shards) == r.whole
                    left[x.key] += x["size"]
            assert r.target - min(left.values()) < taken <= r.target + 1e-6
            short += any(d.part for d in draws if d.source == r.source)
    assert short == 4  # the third source is taken twice, whole


def test_split_tree_spends_quotas_exactly_and_draws_hypergeometric(spark):
    quotas = common.saved(spark.createDataFrame([(1, 40), (2, 25), (3, 7)], "sid long, q long"), "q")
    out = mixing.split_tree(quotas, 72, 5, 9).collect()
    assert {s: sum(r.q for r in out if r.sid == s) for s in (1, 2, 3)} == {1: 40, 2: 25, 3: 7}
    assert sorted(sum(r.q for r in out if r.shard == k) for k in range(5)) == [14, 14, 14, 15, 15]
    import math

    draw = mixing.hypergeometric("20L", "30L", "60L", "u")
    n = {r.k: r["count"] for r in spark.range(20000).selectExpr("(id + 0.5) / 20000 AS u").selectExpr(f"{draw} AS k").groupBy("k").count().collect()}
    for k in range(21):
        assert abs(n.get(k, 0) - 20000 * math.comb(30, k) * math.comb(30, 20 - k) / math.comb(60, 20)) <= 1.01


def shingle_set(t):
    w = tuple(words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    return {w[i:i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()


def reach(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_minhash_components(spark, docs, empty, monkeypatch):
    rows = [r for r in ROWS if r[0] is not None]
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = reach(sets, links)
    want = collections.Counter((r[0], len(sets[r[0]]), root[r[0]], r[0] == root[r[0]]) for r in rows)
    for small in (64, 4):  # with 4 the group of copies is a large node: hubs, branches and tiles
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "TILE", 8)
        out = minhash.near_duplicates(docs).filter("doc_id is not null")
        assert got(out, "doc_id", "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    assert got(minhash.near_duplicates(docs).filter("doc_id is not null"), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.deduplicated(docs, 85)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.collect() if r[0] is not None) == sorted({i for i in sets if root[i] == i})


def test_part_counts_never_rule_out_a_link():
    from codecensus.llm import minhash as H
    rng = np.random.default_rng(3)
    ruled_out = 0
    for size in (1, 2, 7, 60, 400, 5000):
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.int64).view(np.uint64)
            other = pool[:size].copy()
            swap = int(rng.integers(0, size // 3 + 1))
            other[:swap] = pool[size:size + swap]
            both = size - swap
            a, b = (np.frombuffer(H.part_counts(np.unique(x)), np.uint8)[None] for x in (pool[:size], other))
            may = bool(H._may_link(a, b, 85)[0])
            assert may or 100 * both < 85 * (2 * size - both)
            ruled_out += not may
    assert ruled_out > 100
    full = np.full((1, H.PARTS), 255, np.uint8)
    assert H._may_link(full, np.ones((1, H.PARTS), np.uint8), 85)[0]  # full counts say nothing


def test_deduplicated_keeps_different_documents_of_one_id(spark, docs):
    rng = random.Random(33)
    a, b, c, d, e, f = (prose(rng, 80) for _ in range(6))
    rows = [(None, a), (None, b), (None, a + " end"), (7, c), (7, d), (8, c + " end"), (9, e), (9, e + " end"), (9, e), (None, f), (20, f), (None, None), (None, None), (30, None), (31, "")]
    left = minhash.deduplicated(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")).collect()
    assert all(r.source == "x" for r in left)
    out = collections.Counter((r.doc_id, r.text) for r in left)
    one = lambda *of: sum(out.pop(x, 0) for x in of) == 1
    assert one((None, a), (None, a + " end")) and one((9, e), (9, e + " end"))
    assert out == collections.Counter([(None, b), (7, c), (7, d), (20, f), (None, None), (30, None), (31, "")])


def test_embedding_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        c = rng.normal(size=16)
        rows += [(len(rows) + k, (c + rng.normal(size=16) * 0.12).tolist(), [0, 1, None][g % 3]) for k in range(12)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, [0.0] * 16, 0), (n + 3, None, 0), (n + 4, [1.0, None], 0),
             (n + 5, [float("nan")] * 16, 1), (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for i, j in itertools.combinations(ok, 2) if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
             and np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= 0.98]
    root = reach(range(len(rows)), links)
    deg = collections.Counter(itertools.chain(*links))
    low = {k: min(rows[i][0] for i in root if root[i] == k) for k in set(root.values())}
    want = collections.Counter((r[0], deg[i], low[root[i]], r[0] == low[root[i]]) for i, r in enumerate(rows))
    assert len(links) > 50
    for tile in (1024, 8):
        monkeypatch.setattr(embeddings, "TILE", tile)
        assert got(embeddings.near_duplicates(df), "vec_id", "n_links", "component_id", "kept") == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_personal_data(docs, empty):
    pats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def brute(t):
        out = []
        for kind, p in pats:
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m[0])
                fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                        "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
                if fine:
                    out.append((kind, *m.span()))
        return out

    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "@", ".", "1", "22", "256", "0", "00", " ", "-", "+", "(", "4111111111111111", "x@y.z", "1.2.3.4", "\n"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), repr(t)
    for r in pii.pii(docs).collect():
        assert r.base_sha256 and (r.spans == "" or set(x.split(":")[0] for x in r.spans.split(",")) <= {*pii.BASE, *pii.LABELS})
    out = {r.doc_id: r for r in pii.pii(docs).collect()}
    t = ROWS[8][1]
    assert (out[108].n_email, out[108].n_ip, out[108].n_card, out[108].n_phone) == (1, 1, 1, 1)
    assert out[108].base_sha256 == hashlib.sha256(pii.spelled(brute(t)).encode()).hexdigest()
    assert out[109].spans == "secret:9:49" and out[100].spans == ""
    assert [r for r in pii.redact(docs).filter("doc_id = 109").collect()][0]["text"] == 'token = "<secret>" x'
    assert pii.pii(empty).count() == 0 and pii.redact(empty).count() == 0


def test_field_decodes_like_brute_force():
    f = pii.Field(steps=20)
    rng = np.random.default_rng(1)
    runs = [[rng.normal(size=len(pii.LABELS)) for _ in range(n)] for n in (1, 2, 3, 3)]
    for r, y in zip(runs, f.decode(runs), strict=True):
        def value(p, r=r):
            return f.t[0, p[0]] + sum(e[k] for e, k in zip(r, p, strict=True)) + sum(f.t[a, b] for a, b in itertools.pairwise(p)) + f.t[p[-1], 0]
        assert abs(value(y.tolist()) - max(map(value, itertools.product(range(len(pii.LABELS)), repeat=len(r))))) < 1e-9


def test_quality_separates_held_out_rows(spark, docs, empty):
    rng = random.Random(11)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(f"{w}%%%" for w in prose(rng, 60).split()), "x") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    out = {r.doc_id: r.score for r in quality.score(common.pick(d, "doc_id", "text"), model).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.3) == bool(i % 3) for i in held]) > 0.95
    odd = quality.score(common.pick(docs, "doc_id", "text"), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert quality.train(empty, labels) is None and quality.train(d, labels.limit(0)) is None
    assert {r.score for r in quality.score(common.pick(docs, "doc_id", "text"), None).collect()} == {0.5}
    kept = quality.accepted(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i] >= 0.3}


def test_quality_fit_equals_a_dense_solution(spark):
    from pyspark.sql import functions as F

    from codecensus.llm import quality as Q
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, len(Q.STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=500) > 0.3).astype(float)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "doc_id long, x array<double>, y double").repartition(5)
    model = Q.fit(rows)
    fold = dict(rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3))).collect())
    learn = np.array([fold[i] > 0 for i in range(500)])
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8) @ model.freq + model.phase
    z = np.c_[np.sqrt(2 / Q.FEATURES) * np.cos(z), np.ones(500)]
    ridge = np.sqrt(Q.RIDGE) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.r_[z[learn], ridge], np.r_[y[learn], np.zeros(z.shape[1])], rcond=None)[0]
    assert np.allclose(model.weights, weights, atol=1e-7)
    # the calibration is the monotone regression of the other rows, by the min-max formula
    raw = z[~learn] @ weights
    v = y[~learn][np.argsort(raw, kind="stable")]
    mean = lambda a, b: v[a:b + 1].mean()
    fit = [max(min(mean(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    assert np.allclose(np.unique(np.round(fit, 9)), np.unique(np.round(model.values, 9)))
    assert (np.diff(model.knots) > 0).all() and ((model.score(x) >= 0) & (model.score(x) <= 1)).all()


def test_isotonic_is_the_best_monotone_fit():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1]))
    assert np.allclose(y, [0, 1 / 3, 1]) and np.allclose(x, [1, 3, 5])


@pytest.mark.parametrize("share", [1e-6, 0.01])
def test_katz_scores(spark, docs, empty, monkeypatch, share):
    monkeypatch.setattr(katz, "VOCABULARY", share)
    src = common.pick(docs, "doc_id", "text").withColumn("train", common.remainder(F.col("doc_id"), 5) != 1)
    model, uni, bi = katz.learn(src)
    out = katz.score(src, model, uni, bi).collect()
    toks = [(r[0], [w.decode() for w in (r[1] or "").encode().lower().split()] + [None]) for r in ROWS]
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    c = collections.Counter(w for i, t in toks if train(i) for w in t)
    total, low = sum(c.values()), max(1, int(np.ceil(sum(c.values()) * share)))
    vocab = {w for w, k in c.items() if k >= low or w is None}
    name = lambda w: w if w in vocab else "<rare>"
    nr = lambda x: [sum(v == r for v in x.values()) for r in range(1, 7)]
    d1, pair = katz.discounts(nr(c)), collections.Counter()
    for i, t in toks:
        if train(i):
            pair.update(itertools.pairwise(["<s>", *map(name, t)]))
    d2 = katz.discounts(nr(pair))
    mass = {w: (d1[c[w]] if c[w] <= 5 else 1) * c[w] for w in vocab}
    p1 = {w: m / (total if sum(mass.values()) < total - 0.5 else total + 1) for w, m in mass.items()}
    p1["<rare>"] = 1 - sum(p1.values())
    n, freed, seen = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w), k in pair.items():
        n[h] += k
        freed[h] += (1 - d2[k]) * k if k <= 5 else 0
        seen[h] += p1[w]

    def p(h, w):
        if h not in n:
            return p1[w]
        if 1 - seen[h] <= 1e-9:
            return (d2[pair[h, w]] if pair[h, w] <= 5 else 1) * pair[h, w] / (n[h] - freed[h])
        bottom = n[h] if freed[h] > 0 else n[h] + 1
        if pair[h, w]:
            return (d2[pair[h, w]] if pair[h, w] <= 5 else 1) * pair[h, w] / bottom
        return (freed[h] or 1) / bottom / (1 - seen[h]) * p1[w]

    for h in ["<s>", "the", "<rare>", "house"]:
        assert abs(sum(p(h, w) for w in p1) - 1) < 1e-6  # exactly normalised
    rare_n, rare_v = total - sum(c[w] for w in vocab), len(c) - len(vocab)
    want = collections.defaultdict(list)
    for i, t in toks:
        s = sum(np.log10(p(h, w)) for h, w in itertools.pairwise(["<s>", *map(name, t)]))
        s += sum(np.log10((c[w] + 0.5) / (rare_n + 0.5 * (rare_v + 1))) for w in t if w not in vocab)
        b = sum(np.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in t)
        want[i].append((len(t), sum(c[w] > 0 for w in t), b, s))
    have = collections.defaultdict(list)
    for r in out:
        have[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert model.tokens == total and have.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(have[i]), sorted(want[i]), atol=2e-4), i
    m, u, b = katz.learn(src.limit(0))
    assert katz.score(src.limit(0), m, u, b).count() == 0
    assert {r.n_known for r in katz.score(src, m, u, b).collect()} == {0}


def test_katz_keeps_rare_pairs_of_a_large_corpus(spark, docs):
    rng = random.Random(9)
    rows = [(0, "filler " * 1_200_000)] + [(i, prose(rng, 40)) for i in range(2, 40)]
    rows += [(100 + i, f"before rarea{i % 3} rareb{i % 3} after") for i in range(3)]  # each word once in 1.2 million tokens
    rows += [(200, "before rarea1 rareb1 after"), (201, "before rarea1 rareb2 after"), (202, "rareb1 unseen rarea1")]
    src = spark.createDataFrame([(*r, r[0] < 200) for r in rows], "doc_id long, text string, train boolean")
    out = {r.doc_id: r.score for r in katz.score(src, *katz.learn(src)).collect()}
    toks = {i: [*t.split(), None] for i, t in rows}
    c = collections.Counter(w for i, t in toks.items() if i < 200 for w in t)
    pair = collections.Counter(x for i, t in toks.items() if i < 200 for x in itertools.pairwise(["<s>", *t]))
    d1, d2 = (katz.discounts([sum(v == r for v in x.values()) for r in range(1, 7)]) for x in (c, pair))
    mass = {w: (d1[k] if k <= 5 else 1) * k for w, k in c.items()}
    total = sum(c.values()) + (sum(mass.values()) >= sum(c.values()) - 0.5)
    p1 = collections.defaultdict(lambda: 1 - sum(mass.values()) / total, {w: m / total for w, m in mass.items()})
    n, freed, seen = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w), k in pair.items():
        n[h] += k
        freed[h] += (1 - d2[k]) * k if k <= 5 else 0
        seen[h] += p1[w]

    def p(h, w):
        bottom = n[h] if freed[h] > 0 else n[h] + 1
        if pair[h, w]:
            return (d2[pair[h, w]] if pair[h, w] <= 5 else 1) * pair[h, w] / bottom
        return (freed[h] or 1) / bottom / (1 - seen[h]) * p1[w] if h in n else p1[w]

    for i in (2, 100, 200, 201, 202):
        assert abs(out[i] - sum(np.log10(p(h, w)) for h, w in itertools.pairwise(["<s>", *toks[i]]))) < 1e-3, i
    assert out[200] > out[201] + 1


def test_long_texts_are_hashed_alike(monkeypatch):
    import pyarrow as pa

    from codecensus.llm import arrays

    col = pa.array(["Abc  d" * 50, None, "", "x y z " * 200, "\tq"])
    whole = [(i, h.tolist(), o.tolist()) for i, h, o in arrays.word_hashes(col)]
    monkeypatch.setattr(arrays, "SEGMENT", 64)
    parts = [(i, h, o) for i, h, o in arrays.word_hashes(col)]
    flat = [parts_h for _, h, _ in parts for parts_h in h.tolist()]
    assert flat == whole[0][1] and sum(len(o) - 1 for _, _, o in parts) == 5
    a = np.array([0, 1, 5, 2**63], np.uint64)
    assert (arrays.unpack(arrays.pack(a), np.uint64) == a).all() and len(arrays.unpack(arrays.pack(a[:0]), np.uint64)) == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    rows = [(i, prose(rng, 120) if i % 4 else " ".join(f"{w}%%%" for w in prose(rng, 120).split()), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(500 + i, rows[1][1], "en", "s1", 1) for i in range(3)] + [(600, rows[2][1] + " mail a@b.cd", "en", "s2", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    docs, kept = spark.read.parquet(d + "/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        new = common.saved(stage(spark, docs, d), "stage")
        assert new.columns == docs.columns, name
        docs = new
        kept.append({r.doc_id: r["text"] for r in docs.collect()})
    assert not any(i % 4 == 0 for i in kept[0] if i < 200) and {i for i in range(200) if i % 4} <= set(kept[0])
    assert 1 in kept[1] and not {500, 501, 502, 600} & set(kept[1])
    assert all("a@b.cd" not in t for t in kept[2].values()) and set(kept[2]) == set(kept[1])
    assert set(kept[3]) <= set(kept[2])
    out = pipeline.run(spark, d)
    assert {"doc_id", "n_pieces", "ids"} <= set(out.columns) and out.count() >= len(kept[3])


def test_katz_lookups_go_in_two_passes(spark, docs, monkeypatch):
    src = common.pick(docs, "doc_id", "text").withColumn("train", common.remainder(F.col("doc_id"), 5) != 1)
    model, uni, bi = katz.learn(src)
    names, written = [], katz._written
    monkeypatch.setattr(katz, "_written", lambda df, name: (names.append(name), written(df, name))[1])
    assert katz.score(src, model, uni, bi).count() == src.count()
    assert names == ["gains", "gains"]


def test_katz_adds_up_what_the_buckets_of_a_pass_give():
    import pandas as pd

    from codecensus.llm.arrays import pack, unpack
    a, b = pack(np.array([1, 2])), pack(np.array([5, 0, 7]))
    got = katz._together(pd.DataFrame({"block": [9] * 4, "kind": [1, 1, 2, 4], "a": [a, b, a, b"x"], "b": [b"", b"", b, b""], "c": [b"", b"", a, b""]}))
    assert got[["block", "kind"]].to_numpy().tolist() == [[9, 1], [9, 2], [9, 4]]
    assert unpack(got["a"][0], np.int64).tolist() == [6, 2, 7] and unpack(got["b"][1], np.int64).tolist() == [5, 0, 7] and got["a"][2] == b"x"
