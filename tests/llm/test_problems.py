"""Each operator against brute force, exact round trips or held-out accuracy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import boilerplate, encoding, languages, leakage, mojibake, near_duplicates, scans, similar_vectors, splitting
from loomdex.llm.words import shingles, word_hashes, words
from loomdex.operators.chunking import tokens

NOUNS = "pool node shelf disk cable window journal mirror quota lease alert fabric witness volume cache policy replica snapshot bundle router".split()
VERBS = "balances keeps drops moves renames counts locks sorts copies merges".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.randrange(100)} {rng.choice(NOUNS)}s while the {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)}."


# --- 1 ---


@pytest.mark.parametrize("limit,overlap", [(60, 0), (60, 15), (100, 30)])
def test_pieces_cover_and_fit(spark, limit, overlap):
    rng = random.Random(limit + overlap)
    texts = [" ".join(sentence(rng) for _ in range(40)), "为什么缓存分区预先占用配对卷？" * 40, "x" * 3000, "\n\n".join(sentence(rng) for _ in range(30)), "混合 text 。" * 200, "😀é" * 900, splitting.FILL * 50 + "文字" * 200, "short"]
    df = spark.createDataFrame([(str(i), t, False, "P", 7) for i, t in enumerate(texts)], "chunk_id string, content string, is_parent boolean, parent_chunk_id string, piece_no int")
    got = splitting.split_oversized(df, child_limit=limit, child_overlap=overlap).orderBy("chunk_id", "piece_no").collect()
    for i, t in enumerate(texts):
        own = [r for r in got if r["chunk_id"] == str(i)]
        assert [r["piece_no"] for r in own] == list(range(len(own))) and all(r["parent_chunk_id"] == "P" for r in own)
        bounds = [r["start"] for r in own] + [len(t)]
        assert bounds[0] == 0
        for r, a, b in zip(own, bounds, bounds[1:]):
            assert tokens(r["content"]) == r["token_estimate"] <= limit
            assert r["content"].endswith(t[a:b]) and t[:b].endswith(r["content"])
            extra = len(r["content"]) - (b - a)
            assert (extra == 0) == (a == 0 or overlap == 0) and tokens(r["content"][:extra]) <= overlap
        assert (len(own) > 1) == (tokens(t) > limit)
    prose = [r for r in got if r["chunk_id"] == "0"]
    assert np.mean([r["content"].rstrip().endswith(".") for r in prose]) >= 0.7


# --- 2 ---


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    topics = rng.normal(size=(12, 64))
    x = topics[rng.integers(0, 12, n)] + rng.normal(size=(n, 64)) * 1.2
    for i in range(0, n, 9):
        x[i] = x[(i * 7 + 1) % n] + rng.normal(size=64) * 0.25
    x[5] = x[6] = x[7]
    return x.astype(np.float32)


def test_similar_vectors_against_brute_force(spark):
    x = clustered(1500)
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    index = similar_vectors.SimilarVectors(similar_vectors.usable(df), shard_rows=250)
    true = {(a, b) for a, b in zip(*np.nonzero(s >= 0.9)) if a < b}
    got = {tuple(r) for r in index.pairs(0.9).collect()}
    assert got <= true | {(5, 6), (5, 7), (6, 7)} and len(got & true) >= 0.98 * len(true) > 50
    top = defaultdict(set)
    for r in index.top(10).collect():
        top[r["id"]].add(r["neighbour"])
    assert set(top) == set(range(0, 1500, 50))
    recall = np.mean([len(top[q] & set(np.argsort(-s[q])[:10])) / 10 for q in top])
    assert recall >= 0.9


def test_top_over_many_shards(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1500, 10)) @ rng.normal(size=(10, 64))).astype(np.float32)
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    index = similar_vectors.SimilarVectors(similar_vectors.usable(df), shard_rows=20)
    assert len(index.centres) == 150
    top = defaultdict(set)
    for r in index.top(10).collect():
        top[r["id"]].add(r["neighbour"])
    assert np.mean([len(top[q] & set(np.argsort(-s[q])[:10])) / 10 for q in range(0, 1500, 50)]) >= 0.95


def test_graph_of_one_and_of_copies(spark):
    assert similar_vectors.Graph(np.ones((1, 64), np.float32) / 8).search(np.ones((1, 64), np.float32) / 8, 4, threshold=0.9)[2][0][1].tolist() == [0]
    df = spark.createDataFrame([(i, [1.0] * 64) for i in range(40)], "vec_id bigint, embedding array<float>")
    index = similar_vectors.SimilarVectors(similar_vectors.usable(df))
    assert index.pairs(0.9).count() == 40 * 39 // 2 and index.nodes.count() == 1


# --- 4 ---


def test_boilerplate_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for s in ("a", "b"):
        for f in range(20):
            for c in range(3):
                ls = [sentence(rng) for _ in range(4)]
                if f % 3 == 0:
                    ls[1:1] = ["  ** SHARE\u00a0this: mail, 5 chats", f"Legal notice {f}"]
                if s == "b" and f < 4:
                    ls.append("too rare")
                rows.append((f"{s}{f}{c}", "\n".join(ls), f"/corpus/{s}/d{f}.md"))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "chunk_id string, content string, file_path string")
    b = boilerplate.Boilerplate(df)
    got = {(r["chunk_id"], r["line_no"]) for r in b.occurrences().collect()}
    assert got == {(r[0], i) for r in rows for i, line in enumerate(r[1].split("\n")) if line.startswith(("  **", "Legal"))}
    assert len({r["block"] for r in b.blocks().collect()}) == 2  # one block of two lines for each source
    cleaned = {r["chunk_id"]: r["content"] for r in b.cleaned().collect()}
    assert cleaned["a00"] == "\n".join(x for x in rows[0][1].split("\n") if not x.startswith(("  **", "Legal")))


# --- 5 ---


def test_scans(spark):
    rng = random.Random(3)
    clean = [" ".join(sentence(rng) for _ in range(5)) for _ in range(300)]
    lex = scans.lexicon(spark.createDataFrame([(t,) for t in clean], "text string"), least_share=1e-4)
    assert "snapshot" in lex.words and not any(c.isdigit() for w in lex.words for c in w)
    assert lex.correct("snap5h0t") == "snapshot" and lex.correct("vvitness") == "witness" and lex.correct("rnirror") == "mirror"
    assert lex.correct("Zanzibar") is None and lex.correct("pool") is None and lex.correct("105") is None
    text = "The pool keeps 5 snap-\nshots while the\nOld guide | 7\nn0de moves the disk.\nPage 3 of 9\n- 12 -\nThe jour­\nnal drops it."
    fixed, damage = scans.repair(text, "Old Guide", lex)
    assert damage == ["cut_word", "header", "misread", "page_number"]
    assert fixed == "The pool keeps 5 snapshots while the node moves the disk.\nThe journal drops it."
    for sound in (clean[0], "A café-sized\nrack keeps 3\nvolumes.", "run svc_a1_b0 on p15 or 0xC0DE", "a" * 50 + "5" * 9, "as a well-\nknown"):
        assert scans.repair(sound, "Old Guide", lex)[1] == [] or "known" in sound
    records = spark.createDataFrame([("chunks", "1", text, "Old Guide", "text", "x.pdf"), ("chunks", "2", clean[1], None, "text", None), ("chunks", "3", "n0de p00l", None, "code", None), ("chunks", "4", None, None, "text", None)], "tab string, rec_key string, text string, title string, kind string, doc string")
    assert [r["rec_key"] for r in scans.repaired(records, lex).collect()] == ["1"]


def test_misread_words_are_found_again():
    rng = random.Random(4)
    lex = scans.Lexicon({w: 1000 for w in [*NOUNS, *VERBS]}, {}, 30_000)
    swaps = {"l": "1", "o": "0", "s": "5", "e": "¢", "t": "†", "m": "rn", "w": "vv", "i": "ı"}
    tried = right = 0
    for w in [*NOUNS, *VERBS]:
        at = [i for i, c in enumerate(w) if c in swaps]
        if at and len(w) > 3:
            i = rng.choice(at)
            tried += 1
            right += lex.correct(w[:i] + swaps[w[i]] + w[i + 1 :]) == w
    assert right >= 0.9 * tried > 10


def test_letters_read_as_two_and_two_as_one():
    sound = "where changes touch which orphaned journal enclosure cluster clock nightly without share environment column disk".split()
    lex = scans.Lexicon({w: 1000 for w in sound}, {}, 30_000)
    read = {"wliere": "where", "clianges": "changes", "toucli": "touch", "wliicli": "which", "orplianed": "orphaned", "witliout": "without", "niglitly": "nightly", "sliare": "share", "joumal": "journal", "endosure": "enclosure", "duster": "cluster", "dock": "clock", "clisk": "disk", "environrnent": "environment", "colurnn": "column"}
    assert {w: lex.correct(w) for w in read} == read
    assert lex.correct("Wliere") == "Where" and all(lex.correct(w) is None for w in [*sound, "cliff", "line", "model"])


# --- 6 ---


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        t = " ".join(sentence(rng) for _ in range(6)).split()
        texts.append(" ".join(t))
        for _ in range(rng.randrange(4)):
            e = list(t)
            for _ in range(rng.randrange(0, 6)):
                e[rng.randrange(len(e))] = rng.choice(NOUNS)
            texts.append(" ".join(e))
    texts += ["one two"] * 3 + ["", "***", None]
    df = spark.createDataFrame([(f"r{i:03}", t, 1) for i, t in enumerate(texts)], "id string, text string, sig int")
    df = df.unionByName(df.limit(5))
    nd = near_duplicates.NearDuplicates(df, 0.7, 3, block=4, crowd=3)
    sets = {f"r{i:03}": set(shingles(word_hashes(words(t)), 3).tolist()) for i, t in enumerate(texts) if t is not None}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    got = {tuple(r) for r in nd.pairs().collect()}
    assert got <= true and len(got) >= 0.97 * len(true)
    assert {(a, b) for a, b in true if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} <= got
    groups = {r["id"]: r["group"] for r in nd.groups().collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in got)


def test_pairs_at_the_threshold_are_all_proposed(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(400):  # 17 and 17 words of one order, 14 + 3 and 14 + 3: 14 of 20 in common
        w = [f"w{rng.randrange(10**9)}" for _ in range(20)]
        texts += [" ".join(w[:17]), " ".join(w[:14] + w[17:])]
    df = spark.createDataFrame([(f"r{i:03}", t) for i, t in enumerate(texts)], "id string, text string")
    got = {tuple(r) for r in near_duplicates.NearDuplicates(df, 0.7, 1).pairs().collect()}
    assert got == {(f"r{i:03}", f"r{i + 1:03}") for i in range(0, 800, 2)}


def test_pruning_table():
    need = near_duplicates.least_matches(0.7, 1e-4, range(5, 101, 5))
    assert all(need[n] <= 0.7 * n for n in need) and need[100] > 40 and sorted(need.values()) == list(need.values())


# --- 7 ---

SAMPLES = {
    "en": ["The pool keeps the old snapshots of the node.", "Every window drops the queued alerts while it waits.", "Replace the cable when the shelf is cold."],
    "de": ["Der Speicher behält die alten Kopien des Knotens.", "Jedes Fenster verwirft die wartenden Meldungen.", "Tauschen Sie das Kabel, wenn das Gehäuse kalt ist."],
    "fr": ["Le groupe conserve les anciennes copies du nœud.", "Chaque fenêtre rejette les alertes en attente.", "Remplacez le câble quand la baie est froide."],
    "es": ["El grupo conserva las copias antiguas del nodo.", "Cada ventana descarta los avisos pendientes.", "Cambie el cable cuando la caja esté fría."],
    "zh": ["存储池保留节点的旧快照。", "每个窗口丢弃等待的告警信息。", "机箱冷却以后更换电缆。"],
    "ja": ["プールはノードの古いコピーを保持します。", "各ウィンドウは待機中の警告を破棄します。", "シェルフが冷えたらケーブルを交換してください。"],
}


def test_languages_held_out(spark):
    rng = random.Random(8)
    rows = []
    for i in range(360):
        code = list(SAMPLES)[i % 6]
        label = code if rng.random() > 0.15 else rng.choice(["en", "fr", None, "und"])
        rows.append((f"t{i}", " ".join(rng.choice(SAMPLES[code][:2]) for _ in range(4)), label))
    rows.append(("t0", rows[0][1], rows[0][2]))
    texts = spark.createDataFrame(rows, "id string, text string, label string")
    model = languages.fit(texts)
    held = [(f"h{c}", s[2], {"en": "English", "de": None, "fr": "fr-FR", "es": "en", "zh": "中文", "ja": "?"}[c]) for c, s in SAMPLES.items()]
    held += [("mixed", SAMPLES["en"][0] + "\n" + SAMPLES["zh"][1] + SAMPLES["de"][1], "en"), ("blank", " ", "en"), ("none", None, "en"), ("signs", "0x55 12 :: --", "en")]
    test = spark.createDataFrame(held, "id string, text string, label string")
    got = {r["id"]: r["langs"] for r in languages.detect(test, model).collect()}
    assert {k: v for k, v in got.items() if k.startswith("h")} == {f"h{c}": [c] for c in SAMPLES}
    assert got["mixed"] == ["de", "en", "zh"] and got["blank"] == [] and got["signs"] == [] and "none" not in got
    fixed = {(r["id"], r["lang"]) for r in languages.corrections(test, model).collect()}
    assert fixed == {("hde", "de"), ("hes", "es"), ("hja", "ja"), ("mixed", "de"), ("mixed", "en"), ("mixed", "zh")}
    segments = next(r for r in languages.detect(test, model).collect() if r["id"] == "mixed")["segments"]
    assert [s["lang"] for s in segments] == ["en", "zh", "de"] and all(0 <= s["confidence"] <= 1 for s in segments)


# --- 8 ---

ODD = ["plain text", "中文 mixed 文字", "😀 emoji \u200d join", "", None, " lead", "<|endoftext|> is text", "a\n\n\tb", "é" * 400]


def test_encoding_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    made = encoding.encode_with_offsets(df)
    back = {r["doc_id"]: r["text"] for r in encoding.decode(made).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    ids = {r["doc_id"]: r["ids"] for r in encoding.encode(df).collect()}
    for r in made.collect():
        t = ODD[r["doc_id"]] or ""
        assert r["ids"] == ids[r["doc_id"]]
        assert all(0 <= a < b <= len(t) for a, b in zip(r["starts"], r["ends"]))
        assert r["starts"] == sorted(r["starts"]) and r["ends"] == sorted(r["ends"]) and (not t or r["ends"][-1] == len(t))
    import tiktoken
    import base64
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(ids[i] == other.encode_ordinary(t or "") for i, t in enumerate(ODD))


# --- 9 ---


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    items = [(f"e{i}", sentence(rng) + " " + sentence(rng), sentence(rng) if i % 2 else None) for i in range(20)]
    items.append(("short", "too short to leak", None))
    docs = []
    for i in range(80):
        body = " ".join(sentence(rng) for _ in range(4)).split()
        e = rng.choice(items[:20])
        w = e[1].split()
        n = rng.choice([0, 8, 11, 12, 13, 20])
        at = rng.randrange(max(1, len(w) - n + 1))
        docs.append((i, " ".join(body[:7] + w[at : at + n] + body[7:]).upper().replace(" ", rng.choice([" ", " - "]))))
    docs += [(90, None), (91, ""), (92, docs[0][1])]
    size = 12
    grams = defaultdict(set)
    for e in items:
        for f in e[1:]:
            ws = words(f or "")
            for k in range(len(ws) - size + 1):
                grams[tuple(ws[k : k + size])].add(e[0])
    true = {(i, c) for i, t in docs for ws in [words(t or "")] for k in range(len(ws) - size + 1) for c in grams.get(tuple(ws[k : k + size]), ())}
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame(items, "id string, question string, reference_answer string")
    for at_once in (40, 100_000):
        got = leakage.leaks(d, e, words_at_once=at_once).where("n_windows > 0").select("doc_id", "case_id").distinct().collect()
        assert {tuple(r) for r in got} == true and len(true) > 10


@pytest.mark.parametrize("bits, radius", [(0, leakage.RADIUS), (leakage.NEAR_BITS, leakage.WIDE_RADIUS)])
def test_blocks_find_all_within_radius(bits, radius):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64)
    blocks = leakage.Blocks(prints, bits, radius)
    for k in range(radius + 1):
        for j in range(len(prints)):
            flipped = prints[j]
            for bit in rng.choice(64, k, replace=False):
                flipped ^= np.uint64(1) << np.uint64(bit)
            assert j in blocks.near(np.array([flipped], dtype=np.uint64))[1]


def test_edited_items_are_found(spark):
    """Items with an edit every nine words, so that no window of twelve is left, inside longer texts; recall over those whose similarity is at least 0.5."""
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {f"i{k}": some(rng.randrange(60, 110)) for k in range(40)}
    rows, expected = [], set()
    for n, (k, ws) in enumerate(items.items()):
        edited = list(ws)
        edited[rng.randrange(len(ws))] = "changed"
        rows.append((n, " ".join(some(70) + edited + some(50))))
        expected.add((n, k))
    cut = [(1000 + n, " ".join(some(30) + ws[:9] + ["x"] + ws[10:19] + ["y"] + some(60))) for n, ws in enumerate(items.values())]
    documents = spark.createDataFrame(rows + cut, "doc_id bigint, text string")
    cases = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "id string, question string")
    index = leakage.Index([(k, "question", " ".join(ws)) for k, ws in items.items()], 200)
    assert index.plain is None  # no item has 200 words
    got = {(r["doc_id"], r["case_id"]): r for r in leakage.leaks(documents, cases).collect()}
    assert set(got) == expected and all(r["n_windows"] > 0 for r in got.values())
    # without equal windows the whole item must be found by its fingerprint
    near = leakage.Index([(k, "question", " ".join(ws)) for k, ws in items.items()], 12)
    near.windows = [("",)] * len(near.windows)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    found = {(i, c) for out in leakage._scan(near, 0.8)(iter([batch])) for i, c in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert found <= expected and len(found) >= 0.9 * len(expected)


# --- 10 ---


def test_garbled_text_is_restored(spark):
    rng = random.Random(12)
    base = ["Don’t remove the café cover — it’s 20 °C “here”.", "Die Prüfsumme der größten Gruppe fällt, während der Knoten läuft.", "为什么缓存分区预先占用配对卷？值班员发现它们。", "ノードの古いコピーを保持します。警告を確認します。"]
    codes = ["en", "de", "zh", "ja"]
    rows = [(i, "\n".join(f"{base[i % 4]} {sentence(rng) if i % 4 < 2 else ''}".strip() for _ in range(3)), codes[i % 4]) for i in range(400)]
    lengths = mojibake.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    wrong = {
        "utf8 as cp1252": lambda t: "".join(chr(b) if (c := bytes([b]).decode("cp1252", "replace")) == "\ufffd" else c for b in t.encode()),
        "utf8 as latin1": lambda t: t.encode().decode("latin-1"),
        "utf8 as mac": lambda t: t.encode().decode("mac_roman"),
        "utf8 as cp437": lambda t: t.encode().decode("cp437"),
    }
    twice = lambda t: wrong["utf8 as latin1"](wrong["utf8 as latin1"](t))
    tried = right = 0
    for f in [*wrong.values(), twice]:
        for i in range(4):
            tried += 1
            right += mojibake.repair(f(rows[i][1]), lengths)[0] == rows[i][1]
    for i, f in ((2, lambda t: t.encode("gb18030").decode("latin-1")), (3, lambda t: t.encode("euc_jp").decode("latin-1")), (1, lambda t: t.encode("cp1252").decode("cp437"))):
        tried += 1
        right += mojibake.repair(f(rows[i][1]), lengths)[0] == rows[i][1]
    assert right >= tried - 2
    for sound in ("NÃO DESLIGAR: AÇÃO EM curso", "ＡＢＣ１２ ── ✅ 💾", "plain", "", "a\u200bb", *(r[1] for r in rows[:8])):
        assert mojibake.repair(sound, lengths) == (sound, [], False)
    assert mojibake.repair("lost \ufffd byte", lengths)[2]
    part = rows[0][1] + "\n" + wrong["utf8 as cp1252"](base[0])
    assert mojibake.repair(part, lengths)[0] == rows[0][1] + "\n" + base[0]


def test_garbled_text_is_judged_by_all_texts(spark):
    rng = random.Random(13)
    n = 2000  # more than any sample
    rows = [(i, f"Der Knoten prüft {sentence(rng)} täglich." + (" Größe " if i % 5 == 0 else "") + ("ŵ" if i == 7 else ""), "de") for i in range(n)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lengths = mojibake.train(documents)
    share = {c: sum(c in t for _, t, _ in rows) / n for c in "üäöß"}
    assert share["ß"] == 0.2 and all(lengths.weights["de"][c] == pytest.approx(math.log(k)) for c, k in share.items())
    assert lengths.weights["de"]["ŵ"] == pytest.approx(math.log(1 / n)) and "ŵ" not in lengths.alphabet
    again = mojibake.train(documents.repartition(7))
    assert again.dictionaries == lengths.dictionaries and again.weights == lengths.weights and again.alphabet == lengths.alphabet


def test_dictionaries_of_parts_are_merged(spark):
    rng = random.Random(14)
    base = ["Don’t remove the café cover — it’s 20 °C “here”.", "Die Prüfsumme der größten Gruppe fällt, während der Knoten läuft."]
    rows = [(i, "\n".join(f"{base[i % 2]} {sentence(rng)}" for _ in range(3)), ["en", "de"][i % 2]) for i in range(1200)]
    rows += [(i, f"L’accès à la rangée {i} est fermé.", "fr") for i in range(1200, 1230)]  # a single part
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    size = {x: sum(len(t.encode()) for _, t, code in rows if code == x) for x in ("en", "de", "fr")}
    assert min(size["en"], size["de"]) > 20 * 6000 > 20 * size["fr"]  # two rounds of merging
    whole, merged = mojibake.train(documents, 4000), mojibake.train(documents, 4000, 6000)
    assert set(merged.dictionaries) == {"en", "de", "fr"} and merged.dictionaries["fr"] == whole.dictionaries["fr"]
    assert max(map(len, merged.dictionaries.values())) <= 4000
    assert merged.alphabet == whole.alphabet and merged.weights == whole.weights
    for i in (0, 1, 1200):
        garbled = "".join(chr(b) if (c := bytes([b]).decode("cp1252", "replace")) == "�" else c for b in rows[i][1].encode())
        assert mojibake.repair(garbled, merged)[0] == rows[i][1]
        assert mojibake.repair(rows[i][1], merged) == (rows[i][1], [], False)
    content = b"".join(mojibake._pieces([t.encode() for _, t, _ in rows[:400]], 50))
    trained = mojibake._dictionary(mojibake._pieces([content], 200), 8000)
    assert mojibake._content(trained)[-200:] == trained[-200:] and b"\1\0\0\0\4\0\0\0" not in mojibake._content(trained) and len(trained) - len(mojibake._content(trained)) < 300
