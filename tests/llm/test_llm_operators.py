"""Each operator against a brute-force version on small tables, odd rows included."""

import base64
import hashlib
import itertools
import random
import re
import struct
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, chat, decontaminate, html_text, license_scan, near_dedup, quality, toxicity, warc
from tessella.llm.queries import public_vocabulary

LONG = "word " * 5000
ODD = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "no id here"), (5, "ÉTÉ naïve — 漢字 🙂\x1c\x85½"), (6, "   \n\t ")]
DOC = "doc_id long, text string, n_words string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "own", "own") for i, t in ODD], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# --- 2


def test_bpe_equals_the_library(spark, odd, none):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert all(library._encode_single_piece(t) == [r] for t, r in ranks.items())  # what the single pair a token relies on
    random.seed(4)
    texts = [(100 + i, "".join(random.choice("aebtn'sre 19\n\té²漢🙂!_") for _ in range(60)), "", "") for i in range(40)]
    rows = odd.unionByName(spark.createDataFrame([*texts, (99, "a" * 700, "", "")], DOC))
    want = sorted((i is None, i or 0, *(lambda ids: (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t, *_ in rows.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(rows, ranks, pattern).collect()) == want
    coded = bpe.encode(rows.where("doc_id = 5"), ranks, pattern, cache_words=0)
    assert coded.select(bpe.unpack(F.col("ids")).alias("x")).first().x == library.encode_ordinary(ODD[6][1])
    assert bpe.digest(none, ranks, pattern).count() == 0


def test_long_words_are_merged_like_short_ones(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(14)
    for _ in range(500):
        word = bytes(random.choice(b"aebtnsre\xc3\xa9l0!") for _ in range(random.randint(1, 80)))
        assert bpe.merge_long(word, ranks) == library._encode_single_piece(word)
    texts = ["".join(random.choice("abtherin") for _ in range(n)) for n in (bpe.FOLD_BYTES, bpe.FOLD_BYTES + 1, 100_000)]
    got = {r.id: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, pattern).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_word_finder_has_equal_ways():
    regex = pytest.importorskip("regex")
    full = regex.compile(bpe.COMMON_PATTERN).findall
    find = bpe.word_finder(bpe.COMMON_PATTERN)
    random.seed(9)
    for _ in range(20_000):
        text = "".join(random.choice("ab Z'stdvelmr0 1²½_\n\t é-!?\x1c\x85ªº一Ⅷ€") for _ in range(random.randint(0, 12)))
        assert [w.decode() for w in find(text.encode())] == full(text)


def test_bpe_makes_no_object_for_each_word(monkeypatch):
    _, pattern = public_vocabulary()
    finder, made = bpe.word_finder, []

    def counting(pattern):
        find = finder(pattern)
        return lambda text: made.append(found := find(text)) or found

    monkeypatch.setattr(bpe, "word_finder", counting)
    texts = ["The quick  brown fox's été, isn't it?\n\n 12 3a " * 50, "", None, "'sad 'll\t!'re x "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    counts = Counter()
    for out in bpe._count_words(pattern)(iter([batch, batch])):
        counts.update(dict(zip(out.column("word").to_pylist(), out.column("n").to_pylist())))
    want = Counter(w for t in texts for w in finder(pattern)((t or "").encode()))
    assert counts == {w: 2 * n for w, n in want.items()}
    assert not made


def test_bpe_words_on_arrays_are_those_of_the_pattern():
    for pattern in (bpe.COMMON_PATTERN, r"\p{L}+|'s"):
        find, scan = bpe.word_finder(pattern), bpe.word_scanner(pattern)
        random.seed(10)
        for k in range(600):
            letters = "ab 'stdvelr '0 1\n\té-!" if k % 2 else "ab Z'stdvelmr0 1²½_\n\t é-!?\x1c\x85ªº一Ⅷ€"
            texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))).encode() for _ in range(20)]
            words, want = scan(texts), [find(t) for t in texts]
            assert [words.word(i) for i in range(len(words.starts))] == [w for found in want for w in found]
            assert np.diff(words.first).tolist() == list(map(len, want))


def test_bpe_tells_words_of_equal_hashes_apart():
    ranks, _ = public_vocabulary()
    kept = [b" abcdefgh-one-", b" abcdefgh-two-", b"q" * 20]
    sizes = np.array(list(map(len, kept)))
    ends, ids = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32), np.array([7, 8, 9], "<u2")
    held = bpe.Vocabulary(np.array([5, 5, 6], np.uint64), ends, b"".join(kept), np.array([0, 2, 4, 6], np.uint32), ids.tobytes(), bpe._tokens(ranks))
    asked = [b" abcdefgh-one-", b" abcdefgh-two-", b" abcdefgh-six-", b"q" * 20, b"q" * 19, b"q" * 20, b"z"]
    sizes = np.array(list(map(len, asked)))
    words = bpe.Words(np.frombuffer(b"".join(asked) + bytes(8), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([0, 7]), np.array([5, 5, 5, 6, 6, 7, 2**64 - 1], np.uint64))
    assert held.find(words).tolist() == [0, 3, 3, 2, 3, 3, 3]


def test_bpe_pieces_of_a_batch_come_together_again(monkeypatch):
    ranks, pattern = public_vocabulary()
    monkeypatch.setattr(bpe, "_CHUNK_BYTES", 64)
    random.seed(12)
    texts = ["", None, *("".join(random.choice(["ther", "in", "zq", " ", "'s", "1", "\n", "ß", "一"]) for _ in range(random.randint(0, 60))) for _ in range(60)), "x" + "ab" * 400, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    find = bpe.word_finder(pattern)
    kept = sorted({w for t in texts for w in find((t or "").encode()) if len(w) <= bpe.FOLD_BYTES})[::2]
    packed = pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([bpe.merge_long(w, ranks) for w in kept], pa.list_(pa.int64()))], names=["word", "ids"])
    (row,) = bpe._pack_words("<u2")(iter([packed]))
    hashes, word_sizes, words, id_sizes, ids = (row.column(name)[0].as_py() for name in bpe._PACKED)
    order = np.argsort(np.frombuffer(hashes, np.uint64), kind="stable")
    word_ends, words = bpe._in_order(np.frombuffer(word_sizes, np.int32), words, order)
    id_ends, ids = bpe._in_order(np.frombuffer(id_sizes, np.int32) * 2, ids, order)
    shared = SimpleNamespace(value=(np.frombuffer(hashes, np.uint64)[order], word_ends, words, id_ends, ids, bpe._tokens(ranks)))

    def folded(split):
        for part in split:
            rare = [[bpe.merge_long(bytes(w), ranks) for w in words] for words in part.column("rare").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rare, pa.list_(pa.list_(pa.int64())))], names=["id", "known", "places", "folded"])

    out = pa.Table.from_batches(bpe._joined("<u2", SimpleNamespace(value=bpe._tokens(ranks)))(folded(bpe._split_texts(pattern, shared)(iter([batch])))))
    assert out.column("id").to_pylist() == list(range(len(texts)))
    assert out.column("decoded").to_pylist() == [(t or "").encode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in out.column("ids").to_pylist()] == [[i for w in find((t or "").encode()) for i in bpe.merge_long(w, ranks)] for t in texts]


def test_bpe_decodes_packed_ids(spark):
    ranks, _ = public_vocabulary()
    rows = spark.createDataFrame([(1, struct.pack("<3I", 0, 50255, 300)), (2, b""), (3, None), (4, struct.pack("<I", 5))], "id int, ids binary")
    token = bpe._tokens(ranks)
    got = {r.id: None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(rows, ranks).collect()}
    assert got == {1: token[0] + token[50255] + token[300], 2: b"", 3: None, 4: token[5]}
    with pytest.raises(Exception, match="IndexError"):
        bpe.decode(spark.createDataFrame([(1, struct.pack("<I", 1 << 20))], "id int, ids binary"), ranks).collect()


# --- 3


def test_chat_round_trip_and_order(spark):
    rows = [
        (1, 0, "user", "hi \\0 \\1"), (1, 1, "assistant", "<|im_end|><|im_start|>\\"), (2, 0, "system", None), (2, 1, "user", "[/INST]"), (2, 2, "assistant", ""), (3, 0, "user", "a"), (3, 1, "user", "b"),
        (4, 0, None, "x"), (5, None, "user", "n"), (5, 1, "assistant", "m"), (5, 1, "assistant", "m"), (None, 0, "user", "z"), (6, 0, "<|im_sep|>", "<|im_sep|>"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.id: r for r in chat.format_chats(frame).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments"))).collect()}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), lambda r: r[0]):
        turns = sorted(group, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].back] == [(r[2] or "", r[3] or "") for r in turns]
        assert got[conv].loss == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    assert [got[c].valid for c in (1, 2, 3, 4, 5, 6)] == [True, True, False, False, False, False]
    assert (got[3].bad_turn, got[4].bad_turn, got[5].bad_turn, got[1].bad_turn) == (1, 0, 2, None)
    assert chat.format_chats(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(head="aXa", middle="mm", tail="tt", start="s", moves={}, ends=(), trained=())


# --- 4


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, odd, none):
    random.seed(6)
    words = [f"w{i}" for i in range(300)]
    base = [random.choices(words, k=120) for _ in range(4)]
    rows = list(dict.fromkeys((i, t) for i, t in ODD if i is not None))
    for i in range(160):
        w = list(random.choice(base))
        for _ in range(random.choice((0, 1, 3, 6, 9))):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((100 + i, " ".join(w[: random.choice((120, 120, 100))])))
    frame = spark.createDataFrame([*rows, rows[4], (None, "nobody")], "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, shingle=2).collect() if r.id is not None}
    assert got == brute_components(rows, 2, 80)
    kept = [r.doc_id for r in near_dedup.keep_one(frame, shingle=2).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i, (_, c) in got.items() if i == c) and kept.count(None) == 1
    assert near_dedup.digest(none).count() == 0 and near_dedup.keep_one(none).count() == 0
    assert near_dedup.keep_one(odd).columns == odd.columns


def test_near_duplicates_make_sets_of_candidates_only(spark, monkeypatch):
    random.seed(12)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(random.choices(words, k=600))) for i in range(300)]
    rows.append((300, rows[7][1] + " and one more"))
    asked, inner = [], near_dedup._sets_of
    monkeypatch.setattr(near_dedup, "_sets_of", lambda source, ids, size: asked.append(ids.count()) or inner(source, ids, size))
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {i: 7 if i == 300 else i for i in range(301)}
    assert sum(asked) <= 30  # unrelated texts share a tenth of their shingles, and none is a candidate but by chance


# --- 5


def test_html_main_text(spark):
    page = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><nav><ul><li><a>Home</a></ul></nav><div class="cookie-bar">We use cookies</div><article><header><h1>Big&nbsp;news</h1></header>
<p>First &lt;para&gt;<br>goes  on<div class="ad">Buy</div><p>Second <b>bold<p>Third.<form><button>Send</button></form></article><section id="comments"><p>Nice!</p></section><aside>More</aside><footer>&copy; x</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain words only"), (None, "u", "<p>a</p><p>b" + " c" * 20_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.digest(rows).collect()}
    assert got[1].text == "Big news\n\nFirst <para> goes on\n\nSecond bold\n\nThird."
    assert (got[2].text, got[2].n_chars, got[3].text, got[4].text) == ("", 0, "", "plain words only")
    assert got[None].text == "a\n\nb" + " c" * 20_000
    assert html_text.digest(rows.limit(0)).count() == 0


# --- 6


def test_license_places_equal_brute_force(spark, odd, none):
    random.seed(8)
    parts = ["under the MIT license", "Apache License, Version 2", "CC BY-NC", "cc by", "the mit license", "version 2", "x", "under"]
    rows = [(100 + i, " ".join(random.choice(parts) for _ in range(random.randint(1, 12)))) for i in range(60)]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = []
    for i, t in [*ODD, *rows]:
        w = alnum(t)
        places = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        want.append((i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.digest(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    notice = "x Redistribution and use in source or binary forms, with or without any modification, are permitted provided that the following conditions are met: y"
    got = license_scan.digest(spark.createDataFrame([(1, notice)], "doc_id long, text string")).first()
    assert got.labels == "bsd" and 0.7 <= got.score < 1
    assert license_scan.digest(none).count() == 0


# --- 7 and 1


@pytest.fixture(scope="module")
def judged(spark):
    random.seed(12)
    words = ["".join(random.choice(["ta", "re", "mo", "li", "su", "ne"]) for _ in range(3)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = [random.choice(words) for _ in range(30)]
        toxic, poor = int(i % 8 == 0), int(i % 7 == 0)
        if toxic:
            text[5:5] = random.sample(["gromwit", "blastard", "snivelor"], 2)
        out = " ".join(f"{w}$$$" for w in text) if poor else " ".join(text)
        docs.append((i, out, random.choice(["en", "de"]), "s9" if poor and i % 2 else "s1", len(out)))
        labels.append((i, 1 - poor, toxic))
    labels += [(None, 1, 1), (3, None, None), (99_999, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out(spark, judged, odd, none):
    docs, labels = judged
    got = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    out = [r for r in got.values() if r.held_out]
    assert 200 < len(out) < 400 and all(r.predicted == int(r.doc_id % 8 == 0) for r in out)
    lexicon = toxicity.learn(docs, labels)
    hidden = spark.createDataFrame([(1, "he is a gr0mw1t and a bl@st@rd"), (2, "s n i v e l o r and gromwiiiit"), (3, "reta moli sune"), (4, None), (5, "")], "id long, text string")
    score = {r.id: r.score for r in toxicity.score_texts(hidden, lexicon).collect()}
    assert score[1] > 0.7 and score[2] > 0.7 and max(score[3], score[4], score[5]) < 0.3 and score[4] == score[5]
    assert toxicity.digest(odd, labels).count() == len(ODD) and toxicity.digest(none, labels).count() == 0
    assert {r.score for r in toxicity.digest(docs, labels.limit(0)).collect()} <= {r.score for r in toxicity.digest(docs, labels.limit(0)).limit(1).collect()}
    assert toxicity.reject(docs, lexicon).columns == docs.columns


def test_disguises_of_any_length(spark, judged):
    docs, labels = judged
    tokens = ["s" + "7" * 30 + "upid", "s" + "t" * 60 + "upid", "s  t  u  p  i  d", "y o u a r e a s t u p i d i d i o t", "stuupiid", "gañ4n", "p3ndejó", "s_t_u_p_i_d"]
    assert [list(toxicity.disguised(f"say {t}, so")) for t in tokens] == [[t] for t in tokens]
    assert list(toxicity.disguised("2020 (plain) words! a b")) == ["(plain"]
    lexicon = toxicity.learn(docs, labels)
    told = ["reta 6r" + "0" * 40 + "mwit reta", "g" + "r" * 60 + "omwit", "g  r  o  m  w  i  t", " ".join("retamolisnivelorgromwitsune"), "snivelor", "snniveloor", "gr0mwít", "reta"]
    got = {r.id: r for r in toxicity.score_texts(spark.createDataFrame(list(enumerate(told)), "id long, text string"), lexicon).collect()}
    assert all(got[i].hits >= 1 for i in range(7)) and got[7].hits == 0
    assert got[3].hits >= 2 and got[3].evidence > 1.5 * got[2].evidence  # both words of one spaced run
    once = toxicity.score_texts(spark.createDataFrame([(1, "snivelor"), (2, "gromwit")], "id long, text string"), lexicon).collect()
    assert [r.hits for r in once] == [1, 1]


def test_quality_on_held_out(spark, judged):
    docs, labels = judged
    got = [r for r in quality.digest(docs, labels).collect() if r.held_out]
    assert sum(r.kept == (r.doc_id % 7 != 0) for r in got) >= 0.98 * len(got)
    strange = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, -1)], docs.schema))
    model = quality.learn(docs, labels)
    assert quality.score(strange, model).count() == 5 and quality.reject(docs, model).columns == docs.columns
    assert quality.digest(docs.limit(0), labels).count() == 0 and {r.score for r in quality.digest(strange, labels.limit(0)).collect()} == {1.0}


def test_restore_is_the_best_path():
    model = np.log(np.full((27, 27, 27), 1 / 27))
    assert {t for t, _ in toxicity.restore("c4t", model)} >= {"cat"}
    assert toxicity.restore("", model) == [] and abs(sum(p for _, p in toxicity.restore("l1l", model)) - 1) < 1e-9


# --- 8


def test_warc_round_trip_and_look_up(spark, tmp_path):
    pages = [(3, "http://b.example.com/x?q=1#f", "<p>same\r\n\r\nbody</p>"), (1, "https://a.example.com", "<p>same\r\n\r\nbody</p>"), (2, "http://b.example.com/x?q=1", None), (5, None, ""), (None, "http://é.org/ü v", "néw"), (3, "http://b.example.com/x?q=1#f", "<p>same\r\n\r\nbody</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    top = str(tmp_path)
    warc.write(frame, f"{top}/a")
    warc.build_index(spark, f"{top}/a", f"{top}/i")
    rows = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, f"{top}/a").collect()), key=repr)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kind = {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 5: ("revisit", 2), None: ("response", None)}
    assert rows == sorted(((i or 0, len((h or "").encode()), digest(h), *kind[i]) for i, _, h in pages), key=repr)
    assert warc.entries_of(spark, f"{top}/i").count() == len(pages)
    found = warc.lookup(spark, f"{top}/a", f"{top}/i", "http://b.example.com/x?q=1")
    assert sorted(h["WARC-Record-ID"] for h, _ in found) == ["<urn:page:2>", "<urn:page:3>", "<urn:page:3>"]
    assert warc.lookup(spark, f"{top}/a", f"{top}/i", "https://a.example.com")[0][1] == b"<p>same\r\n\r\nbody</p>"
    assert warc.lookup(spark, f"{top}/a", f"{top}/i", "http://nowhere.org/") == []
    assert warc.url_key("http://User@Blog.A.com:80/p?q#f") == "com,a,blog:80)/p?q"
    assert warc.digest(frame.limit(0)).count() == 0


def test_warc_query_reads_by_its_index(spark, monkeypatch):
    pages = [(i, f"http://h{i % 7}.org/a b{i % 40}" if i % 9 else None, f"<p>{i % 30}</p>") for i in range(120)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 4)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 10)
    monkeypatch.setattr(warc, "BROADCAST_RANGES", 50, raising=False)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.digest(frame).collect())
    assert got == [(i, len(h), "response" if i < 30 else "revisit", None if i < 30 else i % 30) for i, _, h in pages]
    # What the directory does not name is not found: no other way gives rows.
    inner = warc.build_index

    def shorter(spark, path, index):
        inner(spark, path, index)
        kept = spark.read.parquet(f"{index}/directory").limit(0).collect()
        spark.createDataFrame(kept, "first_key string, file string, offset long, length long").write.mode("overwrite").parquet(f"{index}/directory")

    monkeypatch.setattr(warc, "build_index", shorter)
    assert warc.digest(frame).count() == 0


# --- 9


def brute_hits(docs, items):
    windows = []
    for i, t in items:
        w = alnum(t)
        n = min(13, len(w))
        windows += [(i, w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for i, t in docs:
        w, hit, ids = alnum(t), set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    ids |= {item} - {None}
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_equals_brute_force(spark, odd, none):
    random.seed(3)
    w = lambda n: " ".join(random.choice("Abc de f gh ij".split()) for _ in range(n))
    items = [(i, w(n)) for i, n in enumerate((1, 2, 5, 13, 14, 30, 0))] + [(7, None), (None, w(14)), (10, "漢字 été"), (10, "漢字 été")]
    docs = [(200 + i, w(25) + " " + (items[i % 6][1] if i % 3 else "") + "! " + w(10)) for i in range(30)] + [*ODD, (300, "x 漢字-ÉTÉ été")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_hits(docs, items), key=repr)
    assert sorted(map(tuple, decontaminate.digest(frame, bench).collect()), key=repr) == want
    # The same in shards.
    many = decontaminate.scan_hits(frame, bench, shard_bytes=64).select("id", "n_words", "n_hit", F.size("items").alias("k")).collect()
    assert sorted(map(tuple, many), key=repr) == sorted((x[:4] for x in want), key=repr)
    kept = {r.doc_id: r for r in decontaminate.remove(odd.withColumn("n_chars", F.length("text").cast("long")), bench.where("item_id = 4")).collect()}
    assert set(kept) == {i for i, _ in ODD}
    item = " ".join(f"k{i}" for i in range(13))
    one = spark.createDataFrame([(1, "a " * 400 + item + " end", 9), (2, item, 9)], "doc_id long, text string, n_chars long")
    left = decontaminate.remove(one, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars) for r in left] == [(1, len("a " * 400 + " end"))] and "k3" not in left[0].text
    assert decontaminate.digest(none, bench).count() == 0 and decontaminate.digest(frame, bench.limit(0)).where("n_hit > 0").count() == 0


def test_removal_does_not_depend_on_shards(spark):
    rng = random.Random(8)
    word = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    one, two, cross = word("x", 13), word("y", 13), word("z", 20)
    items = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(cross[:13])), (4, " ".join(cross[5:18]))]
    texts = [
        (1, " ".join(word("f", 200) + one + word("f", 200) + two)),  # 13 + 13 of 426 words: only both together are one in twenty
        (2, " ".join(word("f", 900) + cross + word("f", 40))),  # items that overlap: all 18 words go
        (3, " ".join(word("f", 30))), (4, None), (5, ""),
    ]
    texts += [(6, texts[1][1])]
    frame = spark.createDataFrame([(i, t, len(t or ""), "own") for i, t in texts], "doc_id long, text string, n_chars long, source string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, small = (sorted(map(tuple, decontaminate.remove(frame, bench, shard_bytes=n).collect())) for n in (1 << 20, 64))
    assert whole == small and [r[0] for r in small] == [2, 3, 4, 5, 6]
    assert not set(cross[:18]) & set(small[0][1].split()) and small[0][2] == len(small[0][1]) and small[0][1] == small[4][1]


# --- 10


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = [(int(i), [float(v) for v in centres[i % 12] + 0.6 * rng.normal(size=16)]) for i in range(1500)]
    x += [(2000, None), (2020, [0.0] * 16), (2040, [1.0] * 15 + [None]), (2060, [1.0] * 15 + [float("nan")]), (2080, [1.0, 2.0]), (None, [1.0] * 16)]
    x += [(3000 + i, [float(v) for v in centres[0]]) for i in range(60)]
    frame = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, parts=6, wanted=0.95).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v)) for i, v in x if i is not None and (i < 2000 or i >= 3000)]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        s = (m * m[ids == q][0]).sum(1)
        best = sorted((-s[k], ids[k]) for k in range(len(ids)) if ids[k] != q)[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(score - s[ids == v][0]) < 1e-12 for _, v, score in found)
        hit += len({v for _, v, _ in found} & {v for _, v in best})
    assert hit >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [0.5, 0.1])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.digest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.digest(few.limit(0)).count() == 0


# --- methods against brute force


def test_best_run_is_the_greatest_of_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice((-3, -1, -0.5, 0, 0.5, 1, 4)) for _ in range(rng.randint(0, 14))]
        a, b = html_text.best_run(scores)
        most = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)], default=0)
        assert sum(scores[a:b]) == max(most, 0)


def test_html_without_telling_names_and_with_misleading_ones():
    weights = html_text.learn(html_text.LABELLED)
    page = '<div class="q1"><a>Home</a> <a>News</a></div><div class="q2"><p>Real text with a <a>link</a> in it.</p><p>More of it here.</p></div><div class="q9">© 2024 Somebody</div>'
    assert html_text.main_text(page, weights) == "Real text with a link in it.\n\nMore of it here."
    page = ('<article><p>One two three.</p><div class="replica"><p>A replica of it.</p></div><div class="navigation-history"><p>History of it.</p></div><div class="share-price-table"><p>Prices.</p></div>'
            '<div class="share-buttons">Tweet</div><nav>' + '<a href="/">x y</a>' * 400 + '</nav><p>Second half.</p><div class="post-comments">Nice</div></article>')
    assert html_text.main_text(page, weights) == "One two three.\n\nA replica of it.\n\nHistory of it.\n\nPrices.\n\nSecond half."


def test_scattered_words_are_no_license(spark):
    notice = "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    apart = []
    for i in range(len(notice) - 2):
        apart += [*notice[i : i + 3], f"foreign{i}"]
    rows = [(1, " ".join(apart)), (2, " ".join(notice)), (3, " ".join([*notice[:9], "also", *notice[9:]]))]
    got = {r.doc_id: r for r in license_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "" and got[1].score < 0.7
    assert (got[2].labels, got[2].score, got[3].labels) == ("bsd", 1.0, "bsd")


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(27), size=(27, 27)))
    for token in ("c4t", "l1l", "b00k", "a.b.c", "$h1t", "caat", "5t4rr"):
        best = {}
        for way in itertools.product(*toxicity._lattice(token)):
            letters, cost = "".join(x for x, _ in way), sum(c for _, c in way)
            x = y = 0
            score = -cost
            for k in toxicity._symbols(letters):
                score += model[x, y, k]
                x, y = y, k
            score += model[x, y, 0]
            text = letters.strip()
            if text:
                best[text] = max(best.get(text, -np.inf), score)
        top = max(best, key=best.get)
        assert toxicity.restore(token, model)[0][0] == top


def test_co_training_hands_over_what_a_view_is_sure_of():
    views = quality.Views((np.zeros(quality.TEXT_NUMBERS), np.zeros(4)), (np.ones(quality.TEXT_NUMBERS), np.ones(4)), [np.zeros(w) for w in quality.WIDTHS])
    weights = np.zeros(quality.WIDTHS[0])
    weights[1] = 5.0
    x = np.zeros((5, quality.TEXT_NUMBERS))
    x[:, 0] = (-2, -0.1, 0, 0.1, 2)
    told = quality.handed(views, [[quality.Round(weights, 4.0, -4.0)]], 0, x)
    assert told[0] == 0 and told[4] == 1 and np.isnan(told[1:4]).all()
    counts = np.zeros(quality._BINS)
    counts[quality._bin(np.array([-8.0]))] = 5
    counts[quality._bin(np.array([8.0]))] = 30
    counts[quality._bin(np.array([9.0]))] = 20
    good, poor = quality.limits(counts, 50, 0.5)
    assert 8.0 < good <= 9.0 and -8.0 <= poor < 0  # 20 are the most of the good ones, as the next bin has 30 more


def test_quality_combination_is_monotone(spark, judged):
    model = quality.learn(*judged)
    assert model.curves[:, 1].min() >= 0 and model.blend[1:].min() >= 0


def test_ann_parts_are_cut_again(spark):
    """Clustered vectors in two levels: what is probed is a small share, and what is found nearly all."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12)) * 3
    x = [(i, (centres[i % 40] + 0.3 * rng.normal(size=12)).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, parts=4, leaf_rows=500, part_rows=150, wanted=0.97).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    m = np.array([v for _, v in x])
    hit = sum(len(found & set(np.argsort(-(m @ m[q]) + np.where(np.arange(len(m)) == q, np.inf, 0), kind="stable")[:20].tolist())) for q, found in got.items())
    assert set(got) == set(range(0, 4000, 20)) and hit >= 0.93 * 20 * len(got)
    router, probes = ann.fit(m[rng.permutation(4000)[:2000]], 20, 20)
    assert probes <= 6  # of 20 parts
