"""Every operator on a small awkward table, against brute force, round trips or held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from routewatch.llm import boosted_trees, crc32c, decontamination, golay, line_dedup, mixing, quality, secret_scan, simhash_dedup, token_counts, token_records, warc
from routewatch.llm.components import components
from routewatch.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, digest int, fp int, content string, epoch int, lines string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def awkward():
    """Nulls in every column, empty and long texts, copies, repeated rows, shared ids."""
    r = random.Random(4)
    words = ["the", "and", "Über", "été", "don't", "x", "token", "12", "--", "a.b", "ß", "漢字"]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 9)))
    texts = ["\n".join(line() for _ in range(r.randint(1, 6))) for _ in range(30)]
    texts += [None, "", " ", "\n\n", "one", "one  two", "one\ttwo", "ONE two", texts[0], texts[0] + " more", texts[1].replace(" ", "\t "),
              "<|endoftext|> a  <|endoftext|>", "long " * 20_000, "x" * 30_000, "\n".join(texts[2:5] * 3)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src7", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[3], "en", None, None), (None, None, None, None, None), (5, "another text", "en", "src0", 1)]
    return [(*row, "clash", 1, 2, "clash", 3, "clash") for row in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def text_of(row):
    return row[1] or ""


def null_first(value):
    return (value is not None, value if value is not None else 0)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.md5(c), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(docs, rows, empty, digest):
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text_of(row))].append(row[0])
    want = Counter()
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=null_first)):
            want[(i, keep, len(ids), False)] += 1
        want[(keep, keep, len(ids), False)] -= 1
        want[(keep, keep, len(ids), True)] += 1
    run = (lambda d: exact_dedup(d, digest)) if digest else exact_dedup
    assert tuples(run(docs), "doc_id", "keep_id", "group_size", "kept") == +want
    assert run(empty).count() == 0


def plain_line_dedup(rows, window=line_dedup.WINDOW):
    split = {(row[0], hashlib.md5(text_of(row).encode()).digest()): text_of(row).split("\n") for row in rows}
    seen, out = set(), {}
    for key in sorted(split, key=lambda k: (null_first(k[0]), k[1])):
        lines, gone = split[key], set()
        for i in range(len(lines) - window + 1):
            run = tuple(lines[i:i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        out[key] = (len(lines), sum(i - 1 not in gone for i in gone), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return Counter((row[0], *out[row[0], hashlib.md5(text_of(row).encode()).digest()]) for row in rows)


@pytest.mark.parametrize("window", [2, 3])
@pytest.mark.parametrize("line_hash", [line_dedup.line_hash, lambda line: F.xxhash64(line) % 3], ids=["wide", "colliding"])
def test_line_dedup(docs, rows, empty, window, line_hash):
    run = lambda df: line_dedup.line_dedup(df, window, line_hash)
    assert tuples(run(docs), "doc_id", "n_lines", "removed_chunks", "removed_lines", "text") == plain_line_dedup(rows, window)
    assert run(empty).count() == 0


def test_passages_at_any_shift_go(spark):
    """A passage of several lines goes from every text but the first, whatever stands around it; clean texts stay."""
    passage = [f"line {i} of a passage that many texts share and that goes on for some words" for i in range(4)]
    texts = ["\n".join([f"own {d} {i}" for i in range(d)] + passage[:2 + d % 3] + [f"end {d}"]) for d in range(30)]
    found = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [d for d in sorted(found) if not found[d].removed_lines] == [0]
    for d in range(3, 30):
        assert found[d].text == "\n".join([f"own {d} {i}" for i in range(d)] + [f"end {d}"]) and found[d].removed_chunks == 1


def test_crc32c():
    def slow(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (crc32c.POLYNOMIAL if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    r = random.Random(1)
    parts = [b"123456789", b""] + [r.randbytes(n) for n in (1, 7, 127, 128, 129, 700)]
    assert crc32c.crc32c(parts).tolist() == [slow(p) for p in parts] and slow(b"123456789") == 0xE3069283
    assert len(crc32c.crc32c([])) == 0


def test_token_records(spark, docs, rows, empty, tmp_path):
    library = token_records.encoder(WORDS).library
    manifest = token_records.write_records(docs, WORDS, f"file://{tmp_path}/records")
    found = token_records.read_records(manifest).orderBy("start").collect()
    want = []
    for row in rows:
        ids = library.encode(text_of(row), add_special_tokens=False).ids + [token_records.END_ID]
        want.append((row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(want)
    assert [null_first(r.doc_id) for r in found] == sorted(null_first(row[0]) for row in rows)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    assert token_records.read_records(token_records.write_records(empty, WORDS, f"file://{tmp_path}/none")).count() == 0

    path = manifest.orderBy("shard").first().records_file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[14] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="checksum|length"):
        token_records.read_records(manifest).collect()


def test_words_are_encoded_as_whole_texts_are():
    encoder = token_records.encoder(WORDS)
    r = random.Random(2)
    letters = [*"abestE n\n\t'''lvd12!#éÉ漢́\xa0\x1cΣσß", "<|endoftext|>", "'re", "  ", " the"]
    for _ in range(800):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_token_counts_at_every_prefix():
    counter = token_counts.PrefixCounter(BYTES)
    r = random.Random(3)
    letters = [*"abesthEn  \n\n\t'''lvd12!#é漢́\xa0\x1c🙂", "<|endoftext|>", "'ll", "'re", " the"]
    for _ in range(500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        got = np.cumsum(np.frombuffer(counter.deltas(text), np.int8), dtype=int).tolist()
        assert got == [len(counter.library.encode(text[:i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def test_token_counts(docs, rows, empty):
    library = token_counts.counter(BYTES).library
    counted = token_counts.prefix_counts(docs, BYTES)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert tuples(counted, "doc_id", "n_bytes", "n_tokens") == Counter((row[0], len(text_of(row).encode()), size(text_of(row))) for row in rows)
    cuts = {(r.doc_id, r.n_chars) for r in token_counts.cut_points(counted, 7).collect()}
    for row in rows[:20]:
        text = text_of(row)
        assert (row[0], max(i for i in range(len(text) + 1) if size(text[:i]) <= 7)) in cuts
    assert token_counts.prefix_counts(empty, BYTES).count() == 0


def test_quality(spark, docs, rows, empty):
    junk = [(1000 + i, "### $$$ *** " * (i % 9 + 3), None, None, 1, None, 1, 1, None, 1, None) for i in range(120)]
    good = [(2000 + i, "Plain words in a plain sentence. " * (i % 9 + 3), None, None, 1, None, 1, 1, None, 1, None) for i in range(120)]
    table = spark.createDataFrame(rows + junk + good, SCHEMA)
    marks = [(d[0], 0) for d in junk] + [(d[0], 1) for d in good]
    labels = spark.createDataFrame(marks + [(None, 1), (3, None), (junk[0][0], 1)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    found = quality.score(table, model).collect()
    assert len(found) == len(rows) + 240 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert len(held) > 40 and all(r.predicted == (r.doc_id >= 2000) for r in held)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    kept = quality.accepted(table, model)
    assert kept.columns == table.columns and not {r.doc_id for r in kept.collect()} & {d[0] for d in junk}

    nothing = quality.fit(empty, labels)
    assert quality.score(empty, nothing).count() == 0
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_boosted_trees_traverse_as_one_row_at_a_time():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = boosted_trees.train(x, y, trees=30)
    for row, score in zip(x[:50], model.scores(x)):
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95


def plain_matches(rows, items):
    """All windows of an item's size, by their words."""
    words = lambda t: ["".join(c) for c in re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())]
    def grams(w, size):
        return Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))

    out = Counter()
    for row in rows:
        w = words(text_of(row))
        for item_id, text in items:
            item = words(text or "")
            if not item or (len(w) < 5 <= len(item)) or len(w) < min(len(item), 5):
                continue
            k, size = min(5, len(item)), min(len(item), len(w))
            own, best = grams(item, k), (0, 0)
            for start in range(len(w) - size + 1):
                other = grams(w[start:start + size], k)
                shared = sum((own & other).values())
                best = max(best, (shared / (sum(own.values()) + sum(other.values()) - shared), -start))
            if best[0] >= 0.8:
                out[row[0], item_id, -best[1], size, round(best[0], 9)] += 1
    return out


def test_decontamination(spark, docs, rows, empty):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, passage(n)) for i, n in enumerate((12, 12, 25, 40, 40, 60))] + [(6, None), (7, ""), (8, "two words"), (9, passage(4)), (None, passage(30))]
    extra = []
    for i, (_, text) in enumerate(items):
        w = (text or "").split()
        near = [x if k % 23 else "other" for k, x in enumerate(w)]
        for j, t in enumerate((text, f"{passage(20)} {text} {passage(9)}", f"{passage(7)}\n{' '.join(near)}, end", text and text.upper().replace(" ", ",\n"),
                               " ".join(w[: max(1, len(w) * 9 // 10)]), " ".join(w[: len(w) // 2]))):
            extra.append((5000 + 10 * i + j, t, None, None, 1, None, 1, 1, None, 1, None))
    table = spark.createDataFrame(rows + extra, SCHEMA).repartition(4)
    benchmark = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    want = plain_matches(rows + extra, items)
    got = Counter((x[0], x[1], x[2], x[3], round(x[4], 9)) for x in decontamination.contaminated(table, benchmark).collect())
    assert got == want and len(want) > 30
    kept = decontamination.clean(table, benchmark)
    hit = {k[0] for k in want}
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {row[0] for row in rows + extra} - hit
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(table, benchmark.limit(0)).count() == 0
    assert decontamination.clean(table, benchmark.limit(0)).count() == table.count()


def test_golay_keys_meet():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 4000)
    for bit in range(23):
        assert (golay.nearby(words) == golay.nearest(words ^ 1 << bit)[:, None]).any(axis=1).all()
    assert sorted(np.unique((golay.PATTERNS >= 0).sum(axis=1))) == [1, 6]


def test_links_are_all_pairs_within_three_bits(spark):
    r = random.Random(7)
    prints = {0, -1, 1 << 62, -(1 << 63)}
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(8):
            x = base
            for bit in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << bit
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    want = Counter((a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    got = tuples(simhash_dedup.links(spark.createDataFrame([(p,) for p in prints], "fp long")), "u", "v")
    assert got == want and len(want) > 200


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_near_groups(docs, rows, empty):
    prints = [plain_fingerprint(text_of(row)) for row in rows]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and component[i] != component[j]:
                old, new = component[i], component[j]
                component = [new if c == old else c for c in component]
    least = {c: min((row[0] for row, k in zip(rows, component) if k == c and row[0] is not None), default=None) for c in set(component)}
    want = Counter((row[0], p - (1 << 64) if p >> 63 else p, least[c]) for row, p, c in zip(rows, prints, component))
    assert tuples(simhash_dedup.near_groups(docs), "doc_id", "fp", "component_id") == want
    stays = simhash_dedup.one_per_group(docs)
    assert stays.columns == docs.columns and stays.count() == len(set(component))
    assert {r.doc_id for r in stays.collect()} == set(least.values())
    assert simhash_dedup.near_groups(empty).count() == 0 and simhash_dedup.one_per_group(empty).count() == 0


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(500, i) for i in range(501, 560)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {(x.node, x.root) for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, find(x)) for x in list(root)}


def plain_share(children, budget):
    """By hand: give everyone an equal amount per weight until the money is gone."""
    full, out = set(), {}
    while True:
        left = budget - sum(c for n, c, w in children if n in full)
        weights = sum(w for n, c, w in children if n not in full)
        over = [n for n, c, w in children if n not in full and c * weights <= left * w]
        if not over:
            return out | {n: c if n in full else left * w // weights for n, c, w in children}
        full |= set(over)


def test_mixing(spark, docs, rows, empty):
    for budget in (None, 10, 50_000, 10 ** 9):
        found = mixing.mix(docs, budget=budget).collect()
        leaves, held = Counter(), {}
        domain = lambda s: next((d for d, x in mixing.DOMAINS.items() if s in x), "other")
        for row in rows:
            key = (domain(row[3]), row[2] or "", row[3] or "")
            n = len(re.findall(r"[^\x20\x09-\x0D]+", text_of(row)))
            if held.setdefault((row[0], key, text_of(row)), n) is n and (row[0], key, text_of(row)) not in leaves:
                pass
        for (_, key, _), n in held.items():
            leaves[key] += n
        total = min(sum(leaves.values()) * mixing.EPOCHS, sum(leaves.values()) if budget is None else budget)
        allot = {(): total}
        for depth, level in enumerate(mixing.LEVELS):
            after = {}
            for parent, money in allot.items():
                capacity = Counter()
                for leaf, n in leaves.items():
                    if leaf[:depth] == parent:
                        capacity[leaf[:depth + 1]] += n * mixing.EPOCHS
                after |= plain_share([(k, c, mixing.WEIGHTS[level].get(k[-1], 1)) for k, c in capacity.items()], money)
            allot = after
        want = Counter()
        for leaf, money in allot.items():
            for epoch in range(mixing.EPOCHS):
                order = lambda d: (hashlib.md5(f"{mixing.SEED}:{epoch}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), hashlib.md5(d[2].encode()).digest())
                for d in sorted((d for d in held if d[1] == leaf), key=order):
                    if held[d] > money:
                        money = -1
                    if money >= 0:
                        money -= held[d]
                        want[d[0], epoch, *leaf, held[d]] += 1
        assert Counter((r.doc_id, r.epoch, r.domain, r.lang, r.source, r.n_tokens) for r in found) == want
    times = Counter(r.doc_id for r in mixing.mix(docs).collect())
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and Counter(r.doc_id for r in again.collect()) == times
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>é</p>\r\n\r\nWARC/1.1"), (2, "http://a/2", "<p>é</p>\r\n\r\nWARC/1.1"), (3, None, None), (4, "u", ""), (5, "line\nbreak", "x" * 3_000_000),
             (6, "u", "x" * 3_000_000), (7, "u", "one"), (7, "u", "one"), (None, "u", "one"), (None, "u", "alone"), (8, "u", "\r\n\r\n")]
    table = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, digest string, first_id string").repartition(3)
    first = {}
    for page_id, _, html in pages:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    for least in (0, 4):
        want = Counter()
        for page_id, _, html in pages:
            data = (html or "").encode()
            origin = first.get(html or "") if len(data) >= least else page_id
            want[page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if origin == page_id else "revisit", None if origin == page_id else origin] += 1
        mono = warc.write_monolithic(table, f"file://{tmp_path}/mono{least}", least)
        members = warc.normalise(mono, f"file://{tmp_path}/members{least}")
        assert tuples(warc.read_archives(members), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
        assert sum(r.n_records for r in members.collect()) == len(pages)
    one = mono.first().archive.removeprefix("file://")
    inflate = zlib.decompressobj(31)
    inflate.decompress(open(one, "rb").read())
    assert inflate.eof and not inflate.unused_data  # one stream over many records
    assert warc.read_archives(warc.normalise(warc.write_monolithic(table.limit(0), f"file://{tmp_path}/none"))).count() == 0


def test_secret_scan(spark, docs, rows, empty):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["the", "nation", "thentheringstheand", "interestinglyenough", "of", "words"]) for _ in range(n))
    secrets = [(9000 + i, f'{prose(9)} token = "{r.getrandbits(160):040x}" {prose(5)}.', None, None, 1, None, 1, 1, None, 1, None) for i in range(90)]
    plain = [(9500 + i, f"{prose(40)} {r.randint(10 ** 16, 10 ** 17)} /usr/share/{r.choice(['documents', 'dictionaries'])}/wordlist.txt", None, None, 1, None, 1, 1, None, 1, None) for i in range(90)]
    table = spark.createDataFrame(rows + secrets + plain, SCHEMA)
    found = secret_scan.secret_scan(table).collect()
    want = Counter()
    for row in rows + secrets + plain:
        for number, word in enumerate(re.split(r"[\x20\x09-\x0D]+", text_of(row))):
            if len(word.encode()) >= 16:
                want.update((row[0], number, part, x) for part, x in enumerate(re.findall(secret_scan.CANDIDATE, word)))
    assert Counter((x.doc_id, x.word_no, x.part, x.finding) for x in found) == want
    held = [x for x in found if x.held_out and x.doc_id is not None and x.doc_id >= 9000]
    right = sum(x.secret == (9000 <= x.doc_id < 9500 and len(x.finding) == 40) for x in held)
    assert len(held) > 50 and right >= 0.98 * len(held)
    assert secret_scan.secret_scan(empty).count() == 0
    reviewed = spark.createDataFrame([(x.doc_id, x.word_no, x.part, int(len(x.finding) == 40)) for x in found if x.doc_id is not None and x.doc_id >= 9000] + [(None, 1, 1, 1)],
                                     "doc_id long, word_no long, part long, is_secret int")
    again = secret_scan.secret_scan(table, reviewed).collect()
    assert sum(x.secret for x in again if x.doc_id and 9000 <= x.doc_id < 9500 and len(x.finding) == 40) == 90
