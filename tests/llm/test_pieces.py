"""Codecs, tokenizer pieces, cuts, WARC records and packed hash sets on their own."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest

from keytide.llm import blockdedup, idpack, interleave, markup, packing, sideload, tokcount, warc
from keytide.llm.tokens import Encoder, vocabulary

ODD = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'LL", "1", "22", "<|endoftext|>", "<|startoftext|>", "!", "--", "中", "İ", "Σ", "́", "ﬁ", "😀", " the"]


def odd_texts(n, most=12):
    r = random.Random(1)
    return ["".join(r.choices(ODD, k=r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("name", "pieces"), [("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")])
def test_ids_by_pieces_are_the_librarys(name, pieces):
    from tokenizers import Tokenizer

    own, library = Encoder(name, pieces), Tokenizer.from_file(vocabulary(name))
    for text in odd_texts(3000):
        assert list(np.frombuffer(own.encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("name", "pieces"), [("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")])
def test_ids_of_many_texts_are_the_librarys(monkeypatch, name, pieces):
    """Short texts of white space, marks and special strings, every run of up to five white spaces, and prose, by slices of 500 bytes."""
    import itertools

    from tokenizers import Tokenizer

    from keytide.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 500)
    r = random.Random(5)
    spaces = [" ", "\n", "\t", "\x85", "\u3000", "\x1c"]
    texts = odd_texts(3000) + ["".join(x) for n in range(1, 5) for x in itertools.product(["a", " ", "\n"], repeat=n)] + [f"a{''.join(x)}b" for n in range(1, 5) for x in itertools.product(spaces[:4], repeat=n)]
    texts += ["".join(r.choice(["word", " ", " ", "  ", "\n", "é.", "<|endoftext|>", "'s", *spaces]) for _ in range(r.randint(0, 80))) for _ in range(400)] + [None, "", " ", "x" * 2000]
    library = Tokenizer.from_file(vocabulary(name))
    got = list(Encoder(name, pieces).encode_all(pa.array(texts)))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("pieces", ["spaces", "words"])
def test_a_full_cache_changes_nothing(monkeypatch, pieces):
    from keytide.llm import tokens

    name = {"spaces": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}[pieces]
    texts = odd_texts(400, 60)
    plain = Encoder(name, pieces)
    want = [plain.encode(t) for t in texts]
    monkeypatch.setattr(tokens, "CACHE", 8)
    small = Encoder(name, pieces)
    assert [small.encode(t) for t in texts] == want
    monkeypatch.setattr(tokens, "SLICE", 300)
    assert [x.astype("<u4").tobytes() for x in small.encode_all(pa.array(texts))] == want


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}])
def test_other_files_are_given_whole_to_the_library(tmp_path, change):
    import json

    from tokenizers import Tokenizer

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    own, library = Encoder(str(path), "spaces"), Tokenizer.from_file(str(path))
    for text in odd_texts(200):
        assert list(np.frombuffer(own.encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids, text
    with pytest.raises(ValueError):
        tokcount.Counter(str(path))


def test_heap_counts_are_the_librarys():
    from tokenizers import Tokenizer

    own, library = tokcount.counter("byte_bpe_50k.json"), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for text in [*odd_texts(3000), "ab" * 500, "zyxwvu" * 200, "0" * 999]:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 31, 32])
def test_bit_packing(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = r.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = idpack.pack(ids, bits)
        assert len(data) == (n * bits + 7) // 8 and (idpack.unpack(data, n, bits) == ids).all()


def test_random_access(tmp_path):
    r = np.random.default_rng(0)
    docs = [(None if k == 3 else k, r.integers(0, 1 << 16, int(r.integers(0, 90)), dtype=np.uint64).astype(np.uint32)) for k in range(50)]
    path = str(tmp_path / "x.ids")
    w = idpack.Writer(pa.OSFile(path, "wb"), 16, block_ids=64)
    for key, ids in docs:
        w.add(key, ids)
    w.close()
    f = idpack.Reader(pa.OSFile(path))
    whole = np.concatenate([i for _, i in docs])
    assert f.n_ids == len(whole) and f.nulls[3] and f.keys[4] == 4
    for _ in range(200):
        a, b = sorted(r.integers(0, len(whole) + 1, 2))
        assert (np.concatenate([np.zeros(0, np.uint32), *f.ids(int(a), int(b))]) == whole[a:b]).all()
    with pytest.raises(ValueError):
        (tmp_path / "y.ids").write_bytes(b"x" * 99)
        idpack.Reader(pa.OSFile(str(tmp_path / "y.ids")))


def least_cost(places, prices, length):
    best = [0.0] + [1e18] * (len(places) - 1)
    for i in range(1, len(places)):
        for j in range(i - 1, -1, -1):
            n = places[i] - places[j]
            if n > length:
                break
            best[i] = min(best[i], best[j] + (0 if n & (n - 1) == 0 else length - n) + prices[i])
    return best[-1]


def test_cuts_cost_least():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 200)
        ends = np.unique([*(r.randint(1, n) for _ in range(r.randint(1, 8))), n])
        sentences = np.unique(np.array([r.randint(1, n) for _ in range(r.randint(0, 20))], int))
        places, prices = packing.candidates(ends, sentences, 4, 2.0, 5.0)
        cuts = packing.cut(places, prices, 16)
        price, cost = dict(zip(places.tolist(), prices.tolist())), 0.0
        for a, b in zip(cuts, cuts[1:]):
            assert 0 < b - a <= 16
            cost += (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + price[b]
        assert cost == pytest.approx(least_cost(places.tolist(), prices.tolist(), 16))


def test_packed_sequences_cost_least():
    ids = np.random.default_rng(6).integers(100, 40_000, 6000)
    texts = [" ".join(f"w{x}" + "." * int(x % 7 == 0) for x in part) for part in np.array_split(ids, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    run = packing._packer("byte_bpe_50k.json", 0, 64, 16, 2.0, 12.0, False)
    lengths = {}
    for piece in next(run(iter([batch]))).to_pylist():
        lengths[piece["sequence_id"]] = lengths.get(piece["sequence_id"], 0) + piece["length"]
    stream = np.concatenate([np.append(np.frombuffer(packing.encoder("byte_bpe_50k.json", "spaces").encode(t), "<u4"), 0) for t in texts])
    ends = np.flatnonzero(stream == 0) + 1
    sentences = np.flatnonzero(packing._sentence_ids("byte_bpe_50k.json")[stream]) + 1
    places, prices = packing.candidates(ends, sentences, 16, 2.0, 12.0)
    cuts = packing.cut(places, prices, 64)
    sizes = [lengths[k] for k in sorted(lengths)]
    assert sizes == np.diff(cuts).tolist()
    price, ends_at = dict(zip(places.tolist(), prices.tolist())), np.cumsum(sizes).tolist()
    cost = sum((0 if n & (n - 1) == 0 else 64 - n) + price[e] for n, e in zip(sizes, ends_at))
    assert cost == pytest.approx(least_cost(places.tolist(), prices.tolist(), 64))


def drawn(r, n, width, spread=1 << 63):
    high = r.integers(0, 1 << 8 * width if width < 8 else 1 << 63, n, dtype=np.uint64) % np.uint64(spread)
    low = r.integers(0, 5, n, dtype=np.uint64) if width > 8 else None
    return sideload.Values(high, low, r.integers(0, 4, n).astype(np.uint8) * (r.random(n) < 0.1))


def listed(v):
    return list(zip(v.high.tolist(), [None] * len(v) if v.low is None else v.low.tolist(), v.flags.tolist()))


@pytest.mark.parametrize("width", [5, 6, 8, 16])
def test_hash_sets_come_back(width):
    r = np.random.default_rng(1)
    values = drawn(r, 5000, width).distinct()
    for buckets in (13, 70_000, 1 << 20):
        dealt = list(sideload.deal(values, width, buckets))
        assert [x for _, blob in dealt for x in listed(sideload.Packed(blob, width).values())] == listed(values)
        assert len({b for b, _ in dealt}) > (5 if buckets == 13 else 4000)
    whole = sideload.Packed(sideload.pack(values, width), width)
    assert [x for a in range(0, 1 << 16, 1 << 12) for x in listed(whole.values(a, a + (1 << 12)))] == listed(values)
    assert len(sideload.Packed(sideload.pack(values[:0], width), width).values()) == 0


@pytest.mark.parametrize("width", [5, 16])
def test_hash_sets_with_forced_collisions(width):
    """High halves take 40 values, so that the other halves decide; against plain dictionaries."""
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 700):
        values = drawn(r, n, width, 40)
        want = {}
        for h, low, f in listed(values):
            want.setdefault((h, low), []).append(f)
        assert listed(values.distinct()) == sorted((*k, int(np.bitwise_or.reduce(f)) | 2 * (len(f) > 1)) for k, f in want.items())
        other = drawn(r, 300, width, 60)
        got = values.distinct().member(other.high, other.low)
        assert got.tolist() == [(h, low) in want for h, low, _ in listed(other)]


def test_buckets_answer_in_chunks(monkeypatch):
    monkeypatch.setattr(sideload, "CHUNK", 50)
    r = np.random.default_rng(3)
    sent = {t: drawn(r, 400, 16).distinct() for t in range(4)}
    sent[4] = sideload.Values.joined([sent[0][::3], sent[2][::5]]).distinct()
    held = [(t, sideload.Packed(sideload.pack(v, 16), 16)) for t, v in sent.items()]
    assert len(list(sideload._spans([b for _, b in held]))) > 10
    got = {}
    for t, _, blob in sideload._answer(0, held, 16, 0):
        got.setdefault(t, []).extend(x[:2] for x in listed(sideload.Packed(blob, 16).values()))
    keys = {t: [x[:2] for x in listed(v)] for t, v in sent.items()}
    many = {x for v, k in ((v, keys[t]) for t, v in sent.items()) for x, f in zip(k, v.flags) if f & 2 or sum(x in keys[u] for u in keys) > 1}
    assert got == {t: [x for x in k if x in many] for t, k in keys.items() if set(k) & many}


def test_anchors_widen_with_the_data():
    assert [blockdedup.anchor_width(x, 16) for x in (0, 10**9, 10**12, 10**14, 10**19)] == [5, 5, 5, 6, 8]


def test_rolling_hashes_tell_windows_apart():
    w = blockdedup.Words(pa.array(["a b c d e a b c d e", None, "", "b c d"]))
    assert w.ends.tolist() == [10, 10, 10, 13]
    h = w.rolling(3)
    assert h[0] == h[5] and h[1] == h[10] and h[0] != h[1] and h[2] != h[1]
    other = w.rolling(3, True)
    assert other[0] == other[5] and other[1] == other[10] and other[0] != other[1] and (other != h).all()


def test_html_items():
    page = '<p>One <b>two</b></p><figure><img src="a.png" alt="x"><figcaption>Cap &amp; tion</figcaption></figure>tail<script>no</script><!-- no --><img src="media:sha256:ff" alt="alone">'
    items = interleave.items_of(page)
    assert [(i["position"], i["kind"], i["text"], i["caption"]) for i in items] == [(0, "text", "One two", None), (1, "media", None, "Cap & tion"), (2, "text", "tail", None), (3, "media", None, "alone")]
    assert items[3]["digest"] == "ff"
    for broken in ("<p", "<p a='", "<!-- x", "</p></p>", "<figure><figcaption>x", "<<>>", "<script>x", "<img>", ""):
        interleave.items_of(broken)


def test_png_comes_back():
    for raw in (b" " * 192, bytes(range(192)) * 5):
        samples, n = interleave.from_png(interleave.to_png(raw, 7))
        assert samples.tobytes() == raw and n == 7
    bad = bytearray(interleave.to_png(b"x" * 192, 3))
    bad[40] ^= 1
    with pytest.raises(ValueError):
        interleave.from_png(bytes(bad))


def test_sequences_resolve(spark):
    pages = spark.createDataFrame([(1, '<p>t</p><img src="media:sha256:%s">' % interleave.media_key("0" * 64, 1)), (2, None)], "id int, html string")
    items = interleave.sequences(pages, keep=["id"])
    assert {r.id: len(r["items"]) for r in items.collect()} == {1: 2, 2: 0}
    facts = interleave.media_facts(interleave.store_media(spark.createDataFrame([("x",), ("x",), (None,)], "text string")))
    assert facts.count() == 2
    got = interleave.resolve(items, facts).collect()
    assert len(got) == 1 and got[0].position == 1 and got[0].media_sha256 is None


def test_plain_text():
    assert markup.plain_text("<title>A b</title><p>x  y<br>z</p><a href='/q'>w</a>") == ("x y\nz\nw", "A b", ["/q"])


PAGES = [(1, "http://a/", "<title>T</title><p>Hello <a href='/x'>there</a>"), (2, None, None), (3, "http://b/ c\r\nd", "<p>é</p>" * 300), (None, "http://a/", ""), (1, "http://a/", "<title>T</title><p>Hello <a href='/x'>there</a>")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    source = {(r.page_id, r.target_uri): r for r in warc.responses(pages).collect()}
    want = sorted(map(str, warc.derivatives(warc.responses(pages)).select(*warc.FIELDS).collect()))
    got = warc.read_files(*warc.write_files(warc.derivatives(warc.responses(pages))))
    assert sorted(map(str, got.select(*warc.FIELDS).collect())) == want and len(want) == 2 * len(PAGES)
    for r in got.collect():
        s = source[r.page_id, r.target_uri]
        assert r.refers_to == s.record_id and r.content_length == len(r.block) and r.block_digest == warc.digest(bytes(r.block))
        if r.record_type == "metadata":
            about = bytes(r.block).decode()
            assert s.block_digest in about and s.payload_digest in about and "source-http-header: HTTP/1.1 200 OK" in about
        elif r.page_id == 1:
            assert bytes(r.block) == b"Hello there"
    assert warc.read_files(*warc.write_files(warc.derivatives(warc.responses(pages.limit(0))))).count() == 0


def test_warc_members_by_offset():
    import gzip

    records = [d for p in PAGES for d in warc.derive(warc.response(*p, "2024-01-01T00:00:00Z"))]
    data = b"".join(gzip.compress(warc.serialize(r), mtime=0) for r in records)
    found = list(warc.members(io.BytesIO(data)))
    assert [warc.parse(x) for _, _, x in found] == records
    for offset, length, raw in found:
        assert gzip.decompress(data[offset : offset + length]) == raw
    with pytest.raises(ValueError):
        warc.parse(warc.serialize(records[0])[:-40])


def records_in(folder):
    """(headers, block) of every record of the .warc.gz files in a folder, by the format's rules alone."""
    import gzip
    from pathlib import Path

    out = []
    for path in sorted(Path(folder).glob("*.warc.gz")):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines)
            n = int(headers["Content-Length"])
            assert first == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
            out.append((headers, rest[:n]))
            data = rest[n + 4 :]
    return out


def test_warc_files_by_other_means(spark):
    """Pages whose text, title and links are known as they are made; records read without this package."""
    import base64
    import hashlib

    r = random.Random(2)
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    pages, want = [], {}
    for k in range(40):
        paragraphs = [" ".join(r.choice(["alpha", "béta", "&amp;", "gamma", "δ"]) for _ in range(r.randint(1, 40 if k else 60_000))) for _ in range(r.randint(1, 5))]
        links = [f"/l{k}/{j}" for j in range(r.randint(0, 3))]
        page = f"<html><head><title>Title {k}</title><script>var x = '<p>no</p>';</script></head><body>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "".join(f"<a href='{x}'></a>" for x in links) + "</body></html>"
        pages.append((k, f"http://h/{k}", page))
        want[f"http://h/{k}"] = ("\n".join(p.replace("&amp;", "&") for p in paragraphs), f"Title {k}", links, page.encode())
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest, folder = warc.write_files(warc.derivatives(warc.responses(df)))
    found = records_in(folder.removeprefix("file:").replace("//", "/"))
    assert len(found) == 2 * len(pages) == sum(x.n_records for x in manifest.collect()) and len({h["WARC-Record-ID"] for h, _ in found}) == len(found)
    sources = {x.target_uri: x for x in warc.responses(df).collect()}
    for headers, block in found:
        text, title, links, page = want[headers["WARC-Target-URI"]]
        source = sources[headers["WARC-Target-URI"]]
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(page) + page
        assert bytes(source.block) == http and source.block_digest == sha(http) and source.payload_digest == sha(page)
        assert headers["WARC-Refers-To"] == source.record_id and headers["WARC-Refers-To-Target-URI"] == source.target_uri and headers["WARC-Refers-To-Date"] == headers["WARC-Date"] == source.warc_date
        assert headers["WARC-Block-Digest"] == sha(block)
        if headers["WARC-Type"] == "conversion":
            assert block.decode() == text and headers["Content-Type"].startswith("text/plain")
        else:
            fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]
            held = lambda k: [v for n, v in fields if n == k]
            assert held("source-record-id") == [source.record_id] and held("source-block-digest") == [sha(http)] and held("source-payload-digest") == [sha(page)]
            assert held("title") == [title] and held("outlink") == links and held("source-http-header") == http.decode().split("\r\n\r\n")[0].split("\r\n")


def test_warc_odd_tables(spark):
    schema = "page_id long, url string, html string"
    empty = spark.createDataFrame([], schema)
    assert warc.read_files(*warc.write_files(warc.derivatives(warc.responses(empty)))).collect() == []
    pages = spark.createDataFrame([*PAGES, *PAGES], schema)
    clash = pages.selectExpr("*", *[f"'x' AS {c}" for c in ("record_id", "block", "target_uri", "path", "offset", "text", "refers_to")])
    plain, other = (sorted(map(str, warc.read_files(*warc.write_files(warc.derivatives(warc.responses(d)))).select(*warc.FIELDS).collect())) for d in (pages, clash))
    assert plain == other and len(plain) == 4 * len(PAGES)


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\nX-A: b\r\n\r\n<p>hello</p>"
    lines = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:x>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Target-URI: http://t/", "Content-Type: application/http", f"Content-Length: {len(block)}"]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:y>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"))
    made = {x.record_type: x for x in warc.derivatives(warc.read_archive(spark, [f"file://{tmp_path}/a.warc.gz"])).collect()}
    assert bytes(made["conversion"].block) == b"hello" and made["metadata"].refers_to == "<urn:x>" and b"source-http-header: X-A: b" in bytes(made["metadata"].block)
