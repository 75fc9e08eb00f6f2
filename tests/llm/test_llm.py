import base64
from collections import Counter as Count
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from basalt.llm import bpe, chat, components, embed_dedup, line_dedup, minhash, mixing, pii, quality, substring, token_count
from basalt.llm.scratch import Scratch
from basalt.llm.words import hashes_of, word_hashes

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = [f"w{i}" for i in range(60)]
TEXTS = [
    None, "", " \t\n", "one two", "one two", " ".join(BASE), " ".join(BASE[:-1] + ["other"]), " ".join(BASE), "x " * 80, LONG, LONG + " end",
    "ΑΣ ΟΔΟΣ naïve ﬁ 🤖🤖 é \x1c\x85 <|endoftext|>", "It's <|startoftext|> we'LL 12345", "a\nb\n\nb", " ".join(BASE[:25]) + " tail " + " ".join(BASE[30:55]),
]
KEY = "a key of this test"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__size` int, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", None, "a", "c"][i % 4], 1, 2, "clash") for i, t in enumerate(TEXTS)]
    rows += [(None, "null id text here", None, None, None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_token_counts_equal_the_library(docs, empty):
    library = token_count.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Count((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(docs))
    got = token_count.token_counts(docs, "word_bpe_49k.json").collect()
    assert Count((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_count.token_counts(empty, "word_bpe_49k.json").count() == 0


def test_every_low_character_is_split_as_the_libraries_do():
    counter, splitter = token_count.Counter(public_tokenizers.path("word_bpe_49k.json")), bpe.Splitter()
    assert not [c for c in map(chr, range(0x558)) if counter.differs[c] or splitter.compared(c)]


def test_byte_bpe_equals_tiktoken_and_round_trips(docs, empty):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Count()
    for i, t in pairs(docs):
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()] += 1
    assert Count(tuple(r) for r in bpe.digests(docs).collect()) == want
    encoded = bpe.encode(docs)
    assert encoded.columns == [*docs.columns, "token_ids"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(encoded).collect())
    assert bpe.digests(empty).count() == bpe.encode(empty).count() == 0


def test_prefix_table_appends_and_edits():
    encoder = bpe.TextCodec("byte_bpe_50k.tiktoken").encoder
    p = bpe.Prefixes(encoder, b" under").append(b"standing").edit(2, 4, b"XY")
    assert p.ids() == encoder.encode(p.piece) and encoder.decode(p.ids()) == p.piece


def test_near_duplicates_equal_brute_force(docs, empty):
    sets = {}
    for i, t in pairs(docs):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    own = {i: i for i in sets if i is not None}
    for _ in own:
        for a in own:
            for b in own:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    own[a] = own[b] = min(own[a], own[b])
    got = minhash.near_duplicates(docs, k=4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), own.get(i), i is None or own[i] == i) for i, s in sets.items()}
    assert len(got) == docs.count()
    kept = minhash.keep(docs, k=4)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_substring_dedup_equals_brute_force(docs, empty):
    seen, want = set(), Count()
    rows = sorted(pairs(docs), key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if (i, t) not in first:
            gone = [False] * len(w)
            for s in range(len(w) - 19):
                k = tuple(w[s : s + 20])
                if k in seen:
                    gone[s : s + 20] = [True] * 20
                seen.add(k)
            first[i, t] = (i, len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
        want[first[i, t]] += 1
    for batches in (1, 2, 4, 8):
        assert Count(tuple(r) for r in substring.digests(substring.dedup(docs, batches)).collect()) == want
    assert substring.dedup(empty).count() == 0


def test_runs_are_merged(spark, docs, tmp_path):
    """Batches of separate jobs: each opens the folder anew; runs without a line in the manifest are not read."""
    rows, folder, done = substring.prepared(docs), f"file://{tmp_path}/index", []
    for n, (low, high) in enumerate(((0, 4), (5, 8), (9, substring.LAST))):
        index = substring.Index.open(spark, folder, most_runs=1)
        assert len(index.runs) == min(n, 2) and index.version == n
        substring.Index.open(spark, folder).write(substring.run_rows(rows, 20, 8))  # a lost job's run
        done.append(substring.dedup_batch(rows.where(f"doc between {low} and {high}"), index))
    index = substring.Index.open(spark, folder, most_runs=1)
    assert len(index.runs) == 2 and index.version == 4  # three batches and one compaction
    got = Count(tuple(r) for d in done for r in substring.digests(d).collect())
    assert got == Count(tuple(r) for r in substring.digests(substring.dedup(docs, 1)).collect())


def test_vectors(spark):
    v = [1.0] + [0.0] * 7
    near = [1.0, 0.1] + [0.0] * 6
    far = [0.0, 1.0] + [0.0] * 6
    rows = [(1, v, 1), (2, v, 1), (3, near, 1), (4, far, 1), (5, v, 2), (6, None, 1), (7, [0.0] * 8, 1), (8, [float("nan")] * 8, 1), (9, v, None), (10, [1.0, None], 1), (11, [1e30] + [0.0] * 7, 1), (None, v, 1)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(frame).collect()}
    alone = {i: (0, i) for i in (4, 5, 6, 7, 8, 9, 10, None)}
    assert got == alone | {i: (3, 1) for i in (1, 2, 3, 11)}
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_dense_label_equals_brute_force(spark):
    """One label of 6,000 vectors at mutual cosine 0.9 and 600 pairs at 0.9801, which sorted projections found in part."""
    draw = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(draw.standard_normal(64))
    across = lambda x: unit(x - (x @ centre)[:, None] * centre)  # noqa: E731  directions at right angles to the centre
    v = np.sqrt(0.9) * centre + np.sqrt(0.1) * across(draw.standard_normal((5400, 64)))
    step = draw.standard_normal((600, 64))
    step = unit(step - (step * v[:600]).sum(axis=1)[:, None] * v[:600])
    v = np.concatenate([v, 0.9801 * v[:600] + np.sqrt(1 - 0.9801**2) * step])
    linked = v @ v.T >= 0.98
    np.fill_diagonal(linked, False)
    assert linked[np.arange(600), np.arange(5400, 6000)].all()
    frame = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(frame).collect()}
    assert [got[i].n_links for i in range(6000)] == linked.sum(axis=1).tolist()
    own = np.arange(6000)
    for _ in range(6000):
        low = np.minimum(own, np.where(linked, own[None, :], 6000).min(axis=1))
        if (low == own).all():
            break
        own = low
    assert [got[i].component_id for i in range(6000)] == own.tolist()


def test_mix_meets_targets(spark, docs, empty):
    frame = spark.createDataFrame([(i, "w " * (1 + i * 7919 % 97), "abcd"[min(3, i % 7)]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(frame).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()))
    by = {}
    for r in rows:
        assert 0 <= r.copies <= 2
        t = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        t[0] += r.size
        t[1] += r.size * r.copies
    assert all(a == s and abs(taken - target) <= 97 for a, taken, s, target in by.values())
    total = sum(x[2] for x in by.values())
    assert abs(sum(x[3] for x in by.values()) - 1.5 * total) < 1e-6 * total
    assert len(mixing.mix(docs).collect()) == docs.count() and mixing.mix(empty).count() == 0
    taken = mixing.apply(frame)
    assert taken.columns == frame.columns and taken.count() == sum(r.copies for r in rows)
    assert mixing.apply(docs).columns == docs.columns


def test_chat_round_trip_and_fingerprints(spark):
    rows = [(1, 0, "user", "a <|im_end|> <\\| \\ <\\\\|x"), (1, 1, "assistant", "é🤖\n<|im_start|>"), (1, 2, "assistant", None), (2, 0, None, None), (None, 0, "odd\\n\nrole <|", "t")]
    records = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn", "to_json(struct(coalesce(role, '') AS role, coalesce(text, '') AS text)) AS json")
    formatted = chat.format_turns(chat.canonical(records))
    got = {r.conv_id: r for r in formatted.select("conv_id", chat.read_back(chat.F.col("formatted")).alias("turns"), chat.masked_text(chat.F.col("formatted"), chat.F.col("loss")).alias("masked")).collect()}
    for c in (1, 2, None):
        assert [(t.role, t.text) for t in got[c].turns] == [(r or "", t or "") for i, _, r, t in rows if i == c]
    assert got[1].masked == "é🤖\n<|im_start|>"
    layouts = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}', '{"prompt": "q", "response": "r"}', '{"instruction": "q", "input": "", "output": "r"}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}', '{"unknown": 1}']
    many = spark.createDataFrame([(i, 0, j) for i, j in enumerate(layouts)], "conv_id long, turn long, json string")
    turns = chat.canonical(many).orderBy("conv_id", "part").collect()
    assert [(t.conv_id, t.role, t.text) for t in turns] == [(i, r, t) for i in range(4) for r, t in (("user", "q"), ("assistant", "r"))]
    assert [r.conv_id for r in chat.unmapped(many).collect()] == [4]


def test_chat_long_turns(spark, tmp_path):
    """Texts longer than a JSON parser takes; a text that reads like a stand-in for another stays what it is."""
    from hashlib import sha256

    long = "é<|x" * 5_300_000
    alike = "long:" + sha256(long.encode()).hexdigest()
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "assistant", long + "2"), (3, 0, "user", alike), (4, 0, alike, "t")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {-1: 2, 1: 2, 2: 1, 3: 1, 4: 1}
    for c in (1, 2, 3, 4):
        said = [(r, t) for i, _, r, t in rows if i == c]
        assert got[c].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert got[c].loss_sha256 == sha256("".join(t for r, t in said if r == "assistant").encode()).hexdigest()
    with pytest.raises(Exception, match="no mapping"):
        chat.canonical(spark.createDataFrame([(1, 0, '{"unknown": 1}')], "conv_id long, turn long, json string"), strict=True).collect()


def test_lines(spark, docs, empty):
    rows = [(i, f"own line number {'abcdefghij'[i]} of text {chr(97 + i) * 9}\nCopyright 20{i:02} by someone, all rights reserved\n\nVisit our page for user {'abcdefghij'[i]} today and every day") for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.keep(frame).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i].split("\n")[0] == rows[i][1].split("\n")[0] and "Copyright" not in got[i] and "Visit" not in got[i] for i in range(1, 8))
    out = line_dedup.keep(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and line_dedup.keep(empty).count() == 0


def test_long_lines_of_two_documents(spark):
    shared = "this notice of twelve plain words stands in two or three documents"
    own = lambda i: "\n".join(" ".join(f"{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}" for k in range(12)) for j in range(6))
    rows = [(i, f"{own(i)}\n{shared}\nshort line of two") for i in range(3)] + [(10, own(0) + "\nend"), (11, own(4)), (12, own(4))]
    got = {r.doc_id: r.text for r in line_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"{own(i)}\nshort line of two" for i in (1, 2))
    assert got[10] == "end" and got[11] == got[12] == own(4)  # equal documents are left to the near-duplicate operator


def test_mixed_leaf(spark):
    """Two families and lines that differ in their last word meet in a leaf."""
    name = lambda i: "".join(chr(97 + (i * 7 + k * i) % 26) for k in range(6)) + chr(97 + i % 26) + chr(97 + i // 26)
    rows = [(i, f"Visit our page for user {name(i)} today and every") for i in range(100)]
    rows += [(100 + i, f"Visit our page for news from our team {name(i)}") for i in range(40)]
    rows += [(200 + i, f"we all agree about {name(i)}") for i in range(8)]
    got = {r.doc_id: r.text for r in line_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(140) if got[i]] == [0, 100] and all(got[i] == t for i, t in rows[140:])


def test_quality_with_few_labels(spark):
    """A tenth of the good and bad documents is labelled; clean documents without a label are kept as often as those with one."""
    draw = np.random.default_rng(2)
    good = [(i, " ".join(f"plain{x}" for x in draw.integers(0, 400, 90))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{'junk' if j < 40 else 'plain'}{x}" for j, x in enumerate(draw.integers(0, 400, 90)))) for i in range(300)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::10]] + [(i, 0, 0) for i, _ in bad[::10]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep(frame, labels).collect()}
    assert sum(i in kept for i, _ in good[::10]) >= 28
    assert sum(i in kept for i, _ in good if i % 10) >= 0.9 * 270
    assert sum(i in kept for i, _ in bad) <= 0.1 * 300


def test_quality(spark, docs, empty):
    good = [(i, " ".join(f"plain{(i * 31 + j * 7) % 400}" for j in range(80))) for i in range(40)]
    bad = [(100 + i, " ".join(f"junk{(i * 17 + j * 3) % 300}###" for j in range(80))) for i in range(20)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in bad[::2]] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(frame, quality.fit(frame, labels)).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept or got[i].base_failed for i, _ in bad)
    assert got[100].n_symbols == 240 and quality.keep(frame, labels).columns == ["doc_id", "text"]
    none = quality.judge(docs, quality.fit(docs, labels.limit(0))).collect()
    assert len(none) == docs.count() and all(r.kept == (not r.base_failed) for r in none)
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0
    h = hashes_of(b"a b c x a b c".split(), word_hashes())
    assert quality.repeated(h) == 6 and quality.measures("a\nb\n\nb", word_hashes())[0][:4] == (3, 3, 0, 1)


def test_surrogates(spark, docs, empty):
    text = "mail ann.lee9@mail5.example.com or ann.lee9@mail5.example.com, call +1 (310) 555-4510, card 4716 5225 6785 2545, host 10.0.0.255, key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff. Frau Müller, Mr. John Smith."
    [(r,)] = [(r,) for r in pii.anonymise(spark.createDataFrame([(text,)], "text string"), KEY).collect()]
    assert len(r["__entities"]) == 8 and not any(e in r.text for e in r["__entities"])
    words = r.text.split()
    assert words[1] == words[3].rstrip(",") and words[1].endswith(".com") and r.text.count("Frau ") == r.text.count("Mr. ") == 1 and "+1 (" in r.text
    many = spark.range(3000).selectExpr("concat('+1 (310) 555-', lpad(id, 4, '0'), ' and u', id, '@x.example.org and 10.1.', id % 256, '.', id div 256) AS text")
    replaced = pii.anonymise(many, KEY).collect()
    assert len({e for r in replaced for e in r["__entities"]}) == 9000 and len({r.text for r in replaced}) == 3000
    assert all(len(r.entities) < 2 for r in pii.collisions(many, KEY).collect())
    out = pii.anonymise(docs, KEY).drop("__entities")
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()}[5] == TEXTS[5] and pii.anonymise(empty, KEY).count() == 0


def test_components(spark, monkeypatch):
    """A long chain, a star, a cycle and a lone link, with and without the last links in one task, and links added later."""
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1040)]
    links = chain[::-1] + star + [(7, 8), (8, 9), (9, 7), (7, 7), (50, 40)]
    frame = spark.createDataFrame(links + links[:5], "a long, b long")
    expected = {i: 100 for i in range(100, 161)} | {i: 1000 for i in range(1000, 1040)} | {7: 7, 8: 7, 9: 7, 50: 40, 40: 40}
    for most in (0, 10, 1000):
        monkeypatch.setattr(components, "TAIL", most)
        scratch = Scratch(spark, "test")
        found = components.components(frame, scratch)
        assert {r.node: r.component for r in found.collect()} == expected
        more = spark.createDataFrame([(100, 1000), (3, 7), (200, 300)], "a long, b long")
        now = {r.node: r.component for r in components.joined(found, more, scratch, "more").collect()}
        assert now == {n: {1000: 100, 7: 3}.get(c, c) for n, c in expected.items()} | {3: 3, 200: 200, 300: 200}
        assert components.components(frame.where("a < 0"), Scratch(spark, "none")).collect() == []


def test_fine_estimates_are_near():
    rng = np.random.default_rng(1)
    for n, share in ((40, 0.8), (400, 0.8), (20_000, 0.8), (20_000, 0.5), (3, 1.0)):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        two = np.unique(np.append(one[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share), dtype=np.uint64)))
        real = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        a, b = (np.frombuffer(minhash.nibbles(minhash.fine(x)), np.uint8) for x in (one, two))
        assert abs(minhash.fine_estimates(a, b[None])[0] - real) < minhash.FINE_MARGIN


def test_quality_fits_on_every_label(spark, monkeypatch):
    """No limit stands between the labels and the model; trusted counts are those of all good documents."""
    rows = [(i, " ".join(f"{'fine' if i % 2 else 'poor'}{(i * 7 + j) % 30}" for j in range(60))) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen, count = [], quality.count_bins
    monkeypatch.setattr(type(docs), "limit", lambda *a: pytest.fail("labels are capped"))
    monkeypatch.setattr(quality, "count_bins", lambda *a: seen.append(count(*a)) or seen[-1])
    model = quality.fit(docs, labels)
    assert model.threshold is not None and [int(x.sum()) for x in seen] == [30 * (60 + 59), 60 * (60 + 59)]


def test_labels_go_to_the_texts(spark, monkeypatch):
    """Texts are not dealt, but for those at places of the filters that tell nothing; every labelled row comes once with its side."""
    monkeypatch.setattr(substring, "FILTER_BITS", 16)
    rows = [(i, f"t{i}") for i in range(6000)] + [(6, "again"), (7, None), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sides = spark.createDataFrame([(i, i % 6 == 0) for i in range(0, 9000, 3)], "doc_id long, good boolean")  # the last ones have no document
    scratch = Scratch(spark, "test")
    frame, told, _ = quality.labelled(docs, sides, scratch)
    known = frame.mapInArrow(told, "good boolean, text string")
    assert sorted((r.good, r.text) for r in known.collect()) == sorted((i % 6 == 0, t) for i, t in rows if i is not None and i % 3 == 0)
    assert "Join" not in known._jdf.queryExecution().executedPlan().toString()
    unsure = spark.read.parquet(f"{scratch.folder}/unsure").count()
    assert 0 < unsure < 600  # some 3,000 of 65,536 places are taken
    scratch.drop()
