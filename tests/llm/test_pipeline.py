import base64
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from basalt.llm import quality
from basalt.llm.words import hashes_of, word_hashes

NOTICE = "Copyright 20{} by someone, all rights reserved"


def corpus():
    """Good documents in three sources with a shared notice, near and exact copies, junk, short, null and empty texts."""
    rows = []
    for i in range(60):
        own = " ".join(f"plain{(i * 31 + j * 7) % 400}of{i}" for j in range(70 + i))
        rows.append((i, f"{own}\n{NOTICE.format(10 + i)}" if i % 3 else own, "abc"[i % 3]))
    for i in range(6):
        text = rows[i * 5][1]
        rows.append((100 + i, text if i % 2 else text.replace(f"plain{(i * 155 + 14) % 400}of{i * 5}", "changed", 1), "c"))
    rows += [(200 + i, " ".join(f"junk{(i * 17 + j * 3) % 300}###" for j in range(80)), None) for i in range(15)]
    return rows + [(300, None, "a"), (301, "", "a"), (302, "too short", "b"), (303, "x " * 90, "b")]


LABELS = [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 0, 0) for i in range(0, 15, 2)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_failed(words):
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j + d for j, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for d in range(3)}
    return len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def judged(rows):
    """Quality: bins counted in one place; the threshold lies midway between the good, each scored without its own trusted counts, and the bad."""
    found = {i: quality.bins(hashes_of([w.encode() for w in split(t)], word_hashes())).tolist() for i, t, _ in rows if split(t)}
    good, bad = {i for i, q, x in LABELS if q and not x}, {i for i, q, _ in LABELS if not q}
    raw, trusted = Counter(), Counter()
    for i, b in found.items():
        raw.update(b)
        trusted.update(b if i in good else [])
    size = 1 << quality.BITS

    def score(b, seen):
        return float(np.mean([np.log((seen[x] + 1) / (seen.total() + size)) - np.log((raw[x] + 1) / (raw.total() + size)) for x in b]))

    held = {i: score(found[i], trusted - Counter(found[i]) if i in good else trusted) for i in good | bad}
    low, high = max(held[i] for i in bad), min(held[i] for i in good)
    assert high > low + 0.01
    scores, limit = {i: score(b, trusted) for i, b in found.items()}, (low + high) / 2
    assert all(abs(s - limit) > 0.002 for s in scores.values())  # the operator counts scores by thousandths
    return [r for r in rows if not base_failed(split(r[1])) and scores[r[0]] >= limit]


def key(line):
    return tuple(re.sub("[0-9]+", "0", " ".join(split(line))).split())


def words(sequence):
    return len(sequence) - " ".join(sequence).count("0")


def tree(group, level):
    """Templates of a group (sequence: lines) by the tree's rule, place by place: sequence -> template."""
    total, size = sum(group.values()), len(next(iter(group)))
    if level == 4 or total < 5 or len(group) < 2:
        return {}
    cells = [Counter() for _ in range(size)]
    for s, n in group.items():
        for at, token in enumerate(s):
            cells[at][token] += n
    fixed = {at: t for at in range(4, size) for t, n in cells[at].items() if n >= 0.8 * total}
    has = [s for s in group if len(fixed) >= 0.8 * (size - 4) and all(s[at] == t for at, t in fixed.items())]
    out, parts = {s: (level, tuple(sorted(group))) for s in has}, defaultdict(dict)
    for s in set(group) - set(has):
        shared = [(cells[at][s[at]], -at, s[at]) for at in range(4, size) if 1 < cells[at][s[at]] < total]
        if shared:
            parts[max(shared)][s] = group[s]
    for part in parts.values():
        out |= tree(part, level + 1)
    return out


def without_lines(rows):
    leaves, holders, own = defaultdict(Counter), defaultdict(set), {}
    for i, text, _ in rows:
        own[i] = {key(x) for x in (text or "").split("\n")} - {()}
        for s in own[i]:
            leaves[len(s), s[:4]][s] += 1
    template = {s: t for leaf in leaves.values() for s, t in tree(leaf, 0).items()}
    for i, held in own.items():
        for s in held:
            holders[template.get(s, s)].add(i)
            holders[s, "alone"].add(i)
    total = {i: sum(map(words, held)) for i, held in own.items()}

    def copy(i, j):
        both = sum(map(words, own[i] & own[j]))
        return 10 * both >= 9 * (total[i] + total[j] - both)

    def gone(i, s):
        among, alone = holders[template.get(s, s)], holders[s, "alone"]
        if len(among) >= 5 and i != min(among):
            return True
        return words(s) >= 10 and 2 <= len(alone) < 5 and i != min(alone) and not copy(i, min(alone))

    return [(i, "\n".join(x for x in text.split("\n") if not key(x) or not gone(i, key(x))), source) for i, text, source in rows]


def representatives(rows):
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := split(t.lower())) else set() for i, t, _ in rows}
    own = {i: i for i in sets}
    for _ in own:
        for a in own:
            for b in own:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    own[a] = own[b] = min(own[a], own[b])
    return [r for r in rows if own[r[0]] == r[0]]


def wanted(rows):
    """Targets by pouring the words out in small steps of one level."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    lo, hi = 0.0, 2.0 * sum(sizes.values())
    for _ in range(100):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * sizes[s], weight[s] * level) for s in names) < 1.5 * sum(sizes.values()) else (lo, level)
    return {s: min(2 * sizes[s], weight[s] * lo) for s in names}


@pytest.mark.parametrize("files", [1, 4])
def test_run_equals_brute_force(spark, tmp_path, files):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = rows
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:3], (judged, without_lines, representatives), strict=True):
        expected = brute(expected)
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(expected), name
    assert len(expected) < len(judged(rows)) and any(NOTICE[:9] not in t for i, t, _ in expected if i % 3 and i < 60)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts, copies = {i: (t, s) for i, t, s in expected}, Counter(r.doc_id for r in got)
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    assert all((r.text, r.source) == texts[r.doc_id] for r in got)
    longest = max(len(split(t)) for t, _ in texts.values())
    for source, target in wanted(expected).items():
        assert abs(sum(n * len(split(texts[i][0])) for i, n in copies.items() if texts[i][1] == source) - target) <= longest
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(list(r.token_ids) == own.encode_ordinary(r.text) for r in got)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == copies
