"""Training-data operators against brute force, the tokenizer libraries and hand-made cases."""

import hashlib
import os
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from busweave.llm import bpe, cotrain, exact, html_blocks, mixing, nearcopies, simhash, substring, tokenfiles, toxicity, vafile  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, "Alpha beta gamma delta", "en", "a", 1),
    (2, "alpha BETA gamma delta", "en", "a", 1),
    (2, "alpha BETA gamma delta", "en", "a", 1),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "own words " + PASSAGE + " end", "en", "b", 1),
    (6, PASSAGE + " other end here", "fr", "c", 1),
    (7, "Ünï cödé's é́ 12345 \n\n  don't <|endoftext|> §", "de", "c", 1),
    (None, PASSAGE, "en", "a", 1),
    (8, "word " * 30_000, "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_links(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    fps = [(i, reference_fingerprint(t)) for i, t, *_ in ROWS]
    low = list(range(len(fps)))
    for _ in fps:
        for x, (_, a) in enumerate(fps):
            for y, (_, b) in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    low[x] = low[y] = min(low[x], low[y])
    smallest = {c: min([i for (i, _), k in zip(fps, low) if k == c and i is not None], default=None) for c in low}
    expected = Counter((i, f"{f:016x}", smallest[c]) for (i, f), c in zip(fps, low))
    assert Counter((r.id, r.fingerprint, r.component_id) for r in got) == expected


def test_simhash_groups_beyond_a_part(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (12, 2))}
    fps |= {int(centres[0]) ^ (1 << k) for k in range(60)}
    edges = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"))
    from busweave.llm.common import components

    got = {r.node: r.root for r in components(edges).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups, found = {}, {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
        found.setdefault(got.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_exact_groups(docs, none):
    got = exact.deduplicate(docs.withColumn("keep_id", F.lit("clash"))).collect()
    assert exact.deduplicate(none).count() == 0
    lowered = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), i) for i, t, *_ in ROWS]
    for r in got:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        ids = [i for k, i in lowered if k == key]
        keep = max([i for i in ids if i is not None], default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()


def test_directory_splits(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    cells, depth = exact.directory(keys, 100)
    per = keys.withColumn("cell", exact.top_bits(F.col("h"), depth)).join(cells, "cell").groupBy("bucket").count().collect()
    assert cells.count() == 1 << depth and sum(r["count"] for r in per) == 4000 and max(r["count"] for r in per) <= 100


def test_top_k_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 420)]
    bad = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = vafile.search(table, table.where("vec_id % 50 = 0")).collect()
    q = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    expected = {
        (a, n + 1, b, s)
        for a in q
        if a % 50 == 0
        for n, (s, b) in enumerate(sorted(((int(q[a] @ q[b]), b) for b in q if b != a), key=lambda x: (-x[0], x[1]))[:5])
    }
    assert {(r.query_id, r.rank, r.id, r.score) for r in got} == expected and len(got) == len(expected)
    assert vafile.search(table.limit(0), table.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, docs, none, monkeypatch):
    texts = [t for _, t, *_ in ROWS] + ["a'" * 120_000, " " * 230_000 + "b", "x" * 150_000, "word  \n\n don't 12é " * 20_000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(table.withColumn("ids", F.lit(1)))).collect()}
    assert len(got) == len(texts) and bpe.decode(bpe.encode(none)).count() == 0
    for i, text in enumerate(texts):
        assert got[i].ids == np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        assert got[i].bytes == (text or "").encode()


def test_mix_takes_its_targets(spark, none):
    rows = [(i, "w " * (i % 700), f"s{i % 7}" if i % 3 else "big") for i in range(900)] + [(9000, None, None), (9001, "one two", None), (9001, "one two", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_counts(table).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(got) == sorted(mixing.mixed_counts(table.repartition(7)).collect())
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full or open_)
        open_ -= full or open_
    by_size = {sizes[s]: target[s] for s in order}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size])
        taken[r.source_size] += r.taken
    for size, words in taken.items():
        assert abs(words - by_size[size]) <= 2 * mixing.BLOCK
    words = Counter()
    for r in mixing.mixed_documents(table).collect():
        words[r.doc_id] += len(r.text.split())
    per = Counter()
    for r in got:
        per[r.doc_id] += r.taken
    assert +words == +per
    assert mixing.mixed_counts(none.select("doc_id", "text", "source")).count() == 0


def test_toxicity_and_quality_on_the_held_out_fold(spark, none):
    rows = [(i, f"plain text number {i % 37} about topic{i % 11}" + (" you idiot scum" if i % 4 == 0 else ""), "en", "a", 30) for i in range(1500)]
    table = spark.createDataFrame(rows + [(5000, None, None, None, None), (5001, "", "en", "a", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(1500)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.toxicity for r in toxicity.score(table, toxicity.fit(table, labels)).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(scored) == 1502 and np.mean([(scored[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97 and scored[5000] == scored[5001] < 0.5
    quality = {r.doc_id: r.quality for r in cotrain.fit(table, labels).score(table).collect()}
    assert len(quality) == 1502 and np.mean([(quality[i] >= 0.5) == (i % 4 != 0) for i in held]) > 0.97
    weights = toxicity.fit(none, labels.limit(0))
    assert not weights.any() and toxicity.score(none, weights).count() == 0
    assert {r.quality for r in cotrain.fit(table, labels.limit(0)).score(table).collect()} == {0.5}


def test_token_files_round_trip(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    folder = str(tmp_path / "files")
    got = sorted(tokenfiles.read_files(tokenfiles.token_files(docs, folder, text_bytes=2000), folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i))
    texts, start = {(i, t) for i, t, *_ in ROWS}, 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        assert any(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() == r.ids for i, t in texts if i == r.doc_id)
        start += r.n_tokens
    empty = str(tmp_path / "none")
    assert tokenfiles.read_files(tokenfiles.token_files(none, empty), empty).count() == 0
    ends = np.cumsum(np.random.default_rng(0).integers(0, 900, 3000))
    code = tokenfiles.EliasFano.of(ends)
    assert [code.select(i) for i in range(3000)] == ends.tolist() == code.values().tolist()


def test_pages(spark):
    page = (
        "<body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>Hello <b>big</b>\n world&nbsp;&lt;b&gt;<br>line"
        "<div class='ad'>buy</div><p><a href=y>all link</a></p><script>var t='</p>';</script><p>s</article>"
        "<div class=comments><p>first!</p></div><footer>f</footer>"
    )
    table = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page)], "page_id long, url string, html string")
    got = html_blocks.extract(table.withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "T & U\nHello big world <b> line\nall link\ns")] * 2 + [(2, ""), (3, "")]
    assert html_blocks.extract(table.limit(0)).count() == 0


LONG = "long text of the article " * 20


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>Opening." + "<div class=notice>n</div>" * 4 + f"<p>{LONG}" + "<p><a href=x>link</a>" * 3 + "<p>Closing.", ["Opening.", LONG, "Closing."]),
        (f"<article><p class=notice>n<p>{LONG}<p>Second</article>", [LONG, "Second"]),
        ("<article><p class=notice>n<div>One</div><p>Two</article>", ["One", "Two"]),
        (f"<div><p class=notice>n</div><p>{LONG}<p>Second", [LONG, "Second"]),
        ("<ul><li>One<li class=share>s<ul><li>inner</ul>s<li>Two</ul><p>Three", ["One", "Two", "Three"]),
        ("<ul><li>One<li class=share>s</ul><p>Two", ["One", "Two"]),
        ("<table><tr><td class=sidebar>s<p>t<table><tr><td>u</table>v<td>One<tr><td>Two</table><p>Three", ["One", "Two", "Three"]),
        ("<dl><dt>One<dd class=ad>a<dt>Two</dl>Three", ["One", "Two", "Three"]),
        ("<article><div class=sidebar>s<p>t</article><article>One</article>", ["One"]),
        ("<html><head><title>t</title><meta charset=x><body><p>One", ["One"]),
        ("<p>One <span class=ad>a<span>b</span>c</span> end<p class=ad>a</p><p>Two", ["One end", "Two"]),
        ("<div>One<select><option>a<option>b</select><div class=menu><div>m</div>n</div>Two</div>", ["One", "Two"]),
    ],
)
def test_pages_with_runs_of_notices_and_open_furniture(page, expected):
    assert html_blocks.main_text(page).split("\n") == [" ".join(e.split()) for e in expected]


@pytest.mark.parametrize("common", [2, 8000])
def test_repeated_windows(spark, docs, none, monkeypatch, common):
    monkeypatch.setattr(substring, "COMMON", common)
    got = substring.remove_repeats(docs.withColumn("n_words", F.lit("clash"))).collect()
    assert len(got) == len(ROWS) and substring.remove_repeats(none).count() == 0
    first = {}
    for i, text, *_ in ROWS:
        words = (text or "").encode().split()
        for k in range(len(words) - 12 if i is not None else 0):
            window = tuple(words[k : k + 13])
            first[window] = min(first.get(window, i), i)
    for r in got:
        words = (r.text or "").encode().split()
        gone = set()
        for k in range(len(words) - 12 if r.doc_id is not None else 0):
            if first[tuple(words[k : k + 13])] < r.doc_id:
                gone |= set(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        assert (r.n_words, r.n_removed, r.kept_text) == (len(words), len(gone), kept)


@pytest.mark.parametrize("bound", [1, 7, 40])
def test_window_hashes_when_words_are_forgotten(bound):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in rng.integers(0, 60, 40)] + [None, PASSAGE, "x " + PASSAGE]
    windows, seen = substring.Windows(3), {}
    windows.codes.bound = bound
    for batch in (texts[:25], texts[25:], texts):
        h1, h2, owner, at = windows.hashes(substring.pa.array(batch, substring.pa.string()))
        expected = [(n, k) for n, t in enumerate(batch) for k in range(len((t or "").split()) - 2)]
        assert list(zip(owner.tolist(), at.tolist())) == expected
        for a, b, (n, k) in zip(h1.tolist(), h2.tolist(), expected):
            assert seen.setdefault(tuple(batch[n].split()[k : k + 3]), (a, b)) == (a, b)
    assert len(set(seen.values())) == len(seen)


def near_copy_groups(rows):
    """Smallest id per row, by brute force over all pairs."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    low = list(range(len(rows)))
    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if low[x] != low[y] and 10 * len(a & b) >= 8 * len(a | b):
                low = [low[y] if k == low[x] else k for k in low]
    ids = {c: min([i for (i, _), k in zip(rows, low) if k == c and i is not None], default=None) for c in low}
    return [ids[c] for c in low]


def planted_near_copies():
    rng = np.random.default_rng(5)
    rows = []
    for base in range(25):
        words = [f"v{k}" for k in rng.integers(0, 4000, 200)]
        rows.append(words)
        for edits in range(1, 12):  # one to eleven changed words: similarity from about 0.95 down to 0.57
            copy = list(words)
            for k in rng.choice(200, edits, replace=False):
                copy[k] = f"e{base}x{k}"
            rows.append(copy)
    texts = [" ".join(w) for w in rows] + [rows[0][0].upper() + " " + " ".join(rows[0][1:]), "", None, "  ", "one two", "One  two", "one three"]
    return [(len(texts) - n, t) for n, t in enumerate(texts)] + [(None, " ".join(rows[12])), (7000, "lonely words of its own, six")]


@pytest.mark.parametrize("part", [256, 4])
def test_near_copies(spark, none, monkeypatch, part):
    monkeypatch.setattr(nearcopies, "PART", part)
    rows = planted_near_copies()
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    expected = near_copy_groups(rows)
    got = nearcopies.near_copies(table).collect()
    assert Counter((r.id, r.component_id) for r in got) == Counter((i, c) for (i, _), c in zip(rows, expected))
    kept = corpus_pipeline.drop_near_copies(spark, table, "").collect()
    stay = [(i, t) for (i, t), c in zip(rows, expected) if i is None or i == c]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(stay) and len(stay) < len(rows)
    assert nearcopies.near_copies(none).count() == 0


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, out, data)
        assert kept.columns == docs.columns and kept.count() <= out.count()
        out = kept
    last = corpus_pipeline.run(spark, data)
    assert last.count() > 0 and last.where("ids IS NULL").isEmpty()
