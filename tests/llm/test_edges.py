"""Clashing names, repeated ids, hot groups and brute-force comparisons that need their own tables."""

import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from basalt.llm import bpe, embed_dedup, line_dedup, minhash, mixing, pii, quality, scratch, substring

CLASHES = ["__size", "__id", "__drop", "__text", "__taken", "__entities", "__gone", "__copies", "id", "said", "row", "drop", "stay", "size", "taken", "same", "of", "n", "copies", "copy", "whole_text", "text_key", "pattern", "surrogates", "n_lines", "n_gone"]


@pytest.fixture(scope="module")
def clashing(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{body} own{i} mail{i}@x.example.org", "ab"[i % 2], *(1000 * i + k for k in range(len(CLASHES)))) for i in range(4)] + [(None, None, None, *[None] * len(CLASHES))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES)).cache()


OPERATORS = {
    "minhash": lambda d, spark: minhash.keep(d),
    "line_dedup": lambda d, spark: line_dedup.keep(d),
    "quality": lambda d, spark: quality.keep(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")),
    "mixing": lambda d, spark: mixing.apply(d),
    "bpe": lambda d, spark: bpe.encode(d).drop("token_ids"),
    "pii": lambda d, spark: pii.anonymise(d, "key", entities_column="found").drop("found"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, clashing, name):
    """Columns of any name come through with their values; an empty table gives an empty one."""
    out = OPERATORS[name](clashing, spark)
    assert out.columns == clashing.columns
    want = {r.doc_id: tuple(r[c] for c in CLASHES) for r in clashing.collect()}
    got = out.collect()
    assert got and all(tuple(r[c] for c in CLASHES) == want[r.doc_id] for r in got)
    assert OPERATORS[name](clashing.limit(0), spark).count() == 0


def test_entities_column_must_be_free(clashing):
    with pytest.raises(ValueError, match="__entities"):
        pii.anonymise(clashing, "key")
    with pytest.raises(ValueError, match="key"):
        pii.anonymise(clashing, "", entities_column="found")


def test_minhash_keeps_unlike_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a, 1), (1, b, 2), (2, c, 3), (2, c, 3), (3, a + " more", 4), (4, None, 5), (4, None, 6), (None, a, 7)]
    got = minhash.keep(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (1, b), (2, c), (4, None), (None, a)])


def test_minhash_family_near_the_threshold(spark, monkeypatch):
    """A family of mutual similarity about 0.7 to 0.9, in blocks of a few members, against all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    draw, base = random.Random(3), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(draw.choice([1, 2, 3, 4, 5])):
            text[draw.randrange(120)] = f"x{i}y{draw.random()}"
        rows.append((i, " ".join(text)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in rows}
    own, changed = {i: i for i in sets}, True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if own[a] != own[b]:
                own[a] = own[b] = min(own[a], own[b])
                changed = True
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == own and 1 < len(set(own.values())) < 120


@pytest.mark.parametrize("cosine", [0.0, 0.9, 0.93, 0.96])
def test_sorted_passes_find_links_of_a_dense_family(spark, cosine):
    """5,000 vectors of one label at that mutual cosine, 500 of them with a partner at 0.981, by windows of 512."""
    draw = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(draw.standard_normal(64))
    away = draw.standard_normal((4500, 64))
    v = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * unit(away - (away @ centre)[:, None] * centre)
    step = draw.standard_normal((500, 64))
    step = unit(step - (step * v[:500]).sum(axis=1)[:, None] * v[:500])
    v = np.concatenate([v, 0.981 * v[:500] + np.sqrt(1 - 0.981**2) * step])
    linked = unit(v) @ unit(v).T >= 0.98
    np.fill_diagonal(linked, False)
    frame = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(frame, window=512).collect()}
    n = np.array([got[i].n_links for i in range(5000)])
    assert (n <= linked.sum(axis=1)).all() and n.sum() >= 0.93 * linked.sum()
    assert all((got[i].component_id < i) == (not got[i].kept) and (n[i] > 0 or got[i].kept) for i in range(5000))


def test_labels_are_compared_as_they_are(spark):
    v = [1.0, 0.0]
    for kind, a, b in (("double", 1.2, 1.7), ("string", "x", "y"), ("date", None, None)):
        rows = [(1, v, a), (2, v, a), (3, v, b)]
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
        assert got == ({1: (0, 1), 2: (0, 2), 3: (0, 3)} if a is None else {1: (1, 1), 2: (1, 1), 3: (0, 3)})


def test_repeated_and_very_long_vectors(spark):
    rows = [(7, [1.0] * 5000, 1), (7, [1.0] * 5000, 1), (8, [2.0] * 5000, 1), (9, [1e300] * 5000, 1), (10, [1.0] * 4999, 1)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter([(7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (9, 3, 7, False), (10, 0, 10, True)])


def test_prefix_table_edits_anywhere():
    encoder, draw = bpe.TextCodec("byte_bpe_50k.tiktoken").encoder, random.Random(1)
    for _ in range(30):
        piece = "".join(draw.choice(["un", "der", "stand", "ing", "é", "x", "7"]) for _ in range(draw.randrange(400, 800))).encode()
        p, start = bpe.Prefixes(encoder, piece), draw.randrange(len(piece))
        p.edit(start, min(len(piece), start + draw.randrange(4)), draw.choice([b"", b"ab", "ü".encode(), b"stand"]))
        assert p.last == encoder.extend([], p.piece)


def test_very_long_piece(spark):
    text = "ab" * 40_000
    [r] = bpe.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    ids = bpe.TextCodec("byte_bpe_50k.tiktoken").encode(text)
    assert r.n_tokens == len(ids)


def test_base_rules_equal_brute_force(spark):
    draw, rows = random.Random(5), []
    for i in range(60):
        n = draw.randrange(0, 120)
        text = "".join(draw.choice(["a", "bé", "###", "c|d", "tail"]) + draw.choice([" ", "\n", "\t", "  ", "\n\n"]) for _ in range(n))
        rows.append((i, text))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(frame, quality.Model(None, None)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j + d for j, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == want


def test_hot_leaf_and_long_lines(spark):
    """One line in every document, a leaf of a thousand unlike lines, and a line of 30,000 words in two documents."""
    draw = random.Random(2)
    name = lambda: "".join(draw.choice("abcdefghij") for _ in range(9))
    long = " ".join(name() for _ in range(30_000))
    rows = [(i, f"the same words in all of them\none two three four {name()} {name()} {name()}" + (f"\n{long}\n{' '.join(name() for _ in range(60_000))}" if i in (3, 5) else "")) for i in range(1000)]
    got = {r.doc_id: r.text for r in line_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, t in rows:
        parts = t.split("\n")
        assert got[i] == "\n".join(parts if i == 0 else [parts[1], *(parts[3:] if i == 5 else parts[2:])])


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_against_brute_force(spark):
    """Distinct, coreferent, no entity left, check digits valid, genders and scripts as they were."""
    draw, rows = random.Random(4), []
    for i in range(400):
        digits = "".join(draw.choice("0123456789") for _ in range(15))
        card = next(f"4{digits[1:]}{d}" for d in range(10) if luhn(f"4{digits[1:]}{d}"))
        rows.append((i, f"Mr. Anton Smith{chr(97 + i % 26)} paid by {card}. Anton Smith{chr(97 + i % 26)} or Smith{chr(97 + i % 26)} wrote from u{i % 50}@mail{i % 7}.example.org, phone 555{i:07}, at 10.{i % 256}.0.{i % 9}. Mary Jones came with Frau Anna Müller."))
    rows += [(400, "Account DE89 3704 0044 0532 0130 00 of г-жа Ольга Иванова; Иванова signed."), (401, "nothing here"), (402, None)]
    out = pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string"), "secret").collect()
    texts, one = {r.doc_id: r.text for r in out}, re.compile(r"Mr\. (\S+) (\S+) paid by (\d{16})\. (\S+) (\S+) or (\S+) wrote from (\S+)@(\S+), phone (\d{10}), at (\S+)\. (\S+) (\S+) came with Frau (\S+) (\S+)\.")
    found, seen = [one.fullmatch(texts[i]).groups() for i in range(400)], defaultdict(set)
    original = [one.fullmatch(t).groups() for _, t in rows[:400]]
    real = {x for o in original for x in (*o[:6], *o[8:], f"{o[6]}@{o[7]}")}
    for old, new in zip(original, found, strict=True):
        assert new[0] == new[3] and new[1] == new[4] == new[5] and luhn(new[2]) and new[2][0] == "4"
        for k, (x, y) in enumerate(zip(old, new, strict=True)):
            if k != 6:  # the same local part at another domain is another address
                seen["mail" if k == 7 else k, x].add(y)
        assert not {*new[:6], *new[8:], f"{new[6]}@{new[7]}"} & real
    assert all(len(v) == 1 for v in seen.values())  # one surrogate an entity
    for k in (1, 2, 8, 9, "mail"):
        given = [next(iter(v)) for (kind, _), v in seen.items() if kind == k]
        assert len(set(given)) == len(given)  # of its own
    address = defaultdict(set)
    for old, new in zip(original, found, strict=True):
        address[old[6:8]].add(new[6:8])
    assert all(len(v) == 1 for v in address.values()) and len({next(iter(v)) for v in address.values()}) == len(address)
    iban, name, again = re.fullmatch(r"Account (DE[\d ]{25}) of г-жа \S+ (\S+); (\S+) signed\.", texts[400]).groups()
    moved = iban.replace(" ", "")[4:] + iban.replace(" ", "")[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and iban != "DE89 3704 0044 0532 0130 00"
    assert name == again != "Иванова" and re.fullmatch("[А-Яа-я]+", name)
    assert texts[401] == "nothing here" and texts[402] is None
    assert {r.doc_id: r.text for r in pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string"), "secret").collect()} == texts
    assert {r.doc_id: r.text for r in pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string"), "other").collect()} != texts


def test_colliding_draws_are_drawn_again(spark):
    """More numbers than a format of few digits holds without collisions; given names beyond the table."""
    rows = [(i, f"phone 55 100 {i:04}.") for i in range(3000)] + [(5000 + i, f"Mrs. {n} Doe") for i, n in enumerate(f"{chr(65 + a)}{chr(97 + b)}nna" for a in range(20) for b in range(10))]
    out = pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    numbers = {re.fullmatch(r"phone (.*)\.", r.text).group(1) for r in out if r.doc_id < 5000}
    names = {r.text.split()[1] for r in out if r.doc_id >= 5000}
    assert len(numbers) == 3000 and not numbers & {f"55 100 {i:04}" for i in range(3000)} and len(names) == 200
    assert pii.collisions(spark.createDataFrame(rows, "doc_id long, text string"), "k").count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, "en", None, 0, 5)], [(None, "a b", "en", "s", 3, 5), (1, None, "en", "s", 0, 5), (1, "", "en", None, 0, 6)]])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """Empty tables, null ids and texts, repeated ids and clashing columns: no stage fails, columns stay."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__size` int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_windows_that_differ_in_one_word_stay(spark):
    """300 passages that are equal but for one word, at each of its places, and one exact repeat."""
    words = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(w if j != i % 20 else f"other{i}" for j, w in enumerate(words))) for i in range(300)]
    rows.append((300, rows[7][1]))
    for batches in (1, (0.3, 0.6)):
        got = {r.doc_id: r.n_removed for r in substring.digests(substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches)).collect()}
        assert {i for i, n in got.items() if n} == {300} and got[300] == 20


def test_batches_leave_no_shuffles_and_no_index(spark, tmp_path):
    """Once the repeats are told, shuffle files and the query's own index take no disk; an index that the caller names stays, the setting is as before."""
    env, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: {f.name for d in env.get().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 5 * 40 + j) % 120}" for j in range(60))) for i in range(80)], "doc_id long, text string")
    folder = Path(scratch.shared_folder(spark).removeprefix("file://"))
    index = substring.Index(spark, f"file://{tmp_path}/index", most_runs=1)
    before, old, set_ = held(), set(folder.glob("index-*")), spark.conf.get(key, None)
    own, named = substring.dedup(docs), substring.dedup(docs, index=index)
    until = time.time() + 10  # block managers delete in the background
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before and set(folder.glob("index-*")) == old and spark.conf.get(key, None) == set_
    assert len(substring.Index.open(spark, index.folder).runs) == 2 and all((tmp_path / "index" / r).is_dir() for r in index.runs)
    got = [sorted(tuple(r) for r in substring.digests(rows).collect()) for rows in (own, own, named)]
    assert got[0] == got[1] == got[2] and sum(r[2] for r in got[0]) > 3000  # a row read twice is whole both times


def test_chat_on_odd_tables(spark, tmp_path):
    """No conversation at all; repeated rows are turns of their own; null ids, roles and texts."""
    from hashlib import sha256

    from basalt.llm import chat

    schema = "conv_id long, turn long, role string, text string, formatted string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert [(r.conv_id, r.n_turns) for r in chat.query(spark, f"{tmp_path}/a").collect()] == [(-1, 2)]
    rows = [(1, 0, "user", "q", "x"), (1, 0, "user", "q", "y"), (1, 1, "assistant", None, "z"), (None, 5, None, "n", "z")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, f"{tmp_path}/b").collect()}
    assert {c: r.n_turns for c, r in got.items()} == {-1: 2, 1: 3, None: 1} and got[1].loss_chars == 0
    assert got[1].turns_sha256 == sha256(b"user\nq\nuser\nq\nassistant\n\n").hexdigest() and got[None].turns_sha256 == sha256(b"\nn\n").hexdigest()
