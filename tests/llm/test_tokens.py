"""Words, encoding, pieces and packing against public tokenizers and plain checks."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, pieces
from tessera.llm import words as W
from tessera.llm.encode import ByteEncoder, _byte_letters, decode_corpus, encode_corpus
from tessera.llm.packing import pack, pack_shard
from tessera.llm.pieces import cut_document, cut_oversized

TEXT = st.text(st.one_of(st.sampled_from(" \n\t\r'sdx.,;日本語éüß中文😀  ​\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    tool = tokenizers.Tokenizer.from_file(f"{W.TOKENIZERS}/byte_bpe_50k.json")
    tool.encode_special_tokens = True
    return tool


@pytest.fixture(scope="module")
def encoder():
    return ByteEncoder(W.TOKENIZERS, "byte_bpe_50k")


@settings(max_examples=200, deadline=None)
@given(text=TEXT)
def test_words_join_to_the_text(text):
    book = W.WordBook()
    assert "".join(book.words[k] for k in book.numbers(text)) == text


@settings(max_examples=150, deadline=None)
@given(text=TEXT)
def test_encoding_equals_the_public_tokenizer(encoder, public, text):
    ids, ends = encoder.encode([text])
    assert ids.tolist() == public.encode(text, add_special_tokens=False).ids


def test_special_long_and_blank_texts(encoder, public):
    texts = [None, "", " ", "\n\n  \n", "<|endoftext|>", "x" * 5000, "ab" * 900, "word " * 3000, "日本語" * 400, "a\u0000b", "  two  spaces\n\n   and lines "]
    ids, ends = encoder.encode(texts)
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == ([] if text is None else public.encode(text, add_special_tokens=False).ids)


def test_vocabulary_entries_are_their_own_fixpoint(encoder, public):
    """Contraction of the bytes of an entry gives the entry itself."""
    with open(f"{W.TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte_of = {c: b for b, c in _byte_letters().items()}
    number = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if all(c in byte_of for c in token)}
    whole = [w for w in number if w != b"<|endoftext|>"]
    assert len(vocabulary) - len(whole) <= 1
    got = encoder._contract(whole)
    assert all(x.tolist() == [number[w]] for w, x in zip(whole, got, strict=True))


def test_one_contraction_at_a_time_gives_the_same(encoder):
    """Steps of many contractions against the definition: the leftmost pair of least rank, again and again."""
    with open(f"{W.TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as file:
        model = json.load(file)["model"]
    rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(model["merges"])}
    letters, random = _byte_letters(), np.random.default_rng(8)
    alphabets = ("etaoin shrdlu", "aab", "--==", "the and ing", "éßü日")
    words = [bytes(alphabet[k] for k in random.integers(len(alphabet), size=random.integers(1, 60))) for alphabet in (a.encode() for a in alphabets) for _ in range(60)]
    for word, got in zip(words, encoder._contract(words), strict=True):
        parts = [letters[b] for b in word]
        while pairs := [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert got.tolist() == [model["vocab"][p] for p in parts]


def test_very_long_words(encoder, public):
    random = np.random.default_rng(4)
    long = "".join("abcdefghijklmnopqrstuvwxyz"[k] for k in random.integers(26, size=2_000_000))
    for text in (long[:100_000], "a" * 100_000, long):
        began = time.perf_counter()
        ids, _ = encoder.encode([text])
        assert len(text) > 100_000 or time.perf_counter() - began < 10
        assert ids.tolist() == public.encode(text, add_special_tokens=False).ids


def test_corpus_round_trip(spark):
    rows = [(1, "naïve café\n"), (2, None), (3, ""), (4, "日本 語"), (4, "日本 語")]
    frame = spark.createDataFrame([(a, b, 7, "clash") for a, b in rows], "doc_id long, text string, ids int, key string")
    ids = encode_corpus(frame, "doc_id", "text")
    assert ids.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    back = sorted((r["doc_id"], r["text"]) for r in decode_corpus(ids, "doc_id", "ids").collect())
    assert back == [(1, "naïve café\n"), (2, ""), (3, ""), (4, "日本 語"), (4, "日本 語")]
    assert encode_corpus(frame.limit(0), "doc_id", "text").count() == 0


@pytest.fixture(scope="module")
def counts():
    return W.TokenCounts(W.TOKENIZERS, "byte_bpe_50k")


SENTENCES = st.lists(st.sampled_from(["The index keeps one row per file.", "\n\n", "\n", " ", "日本語の文です。", "x" * 300, "def f(a):\n    return a\n", "naïve "]), min_size=5, max_size=120)


@settings(max_examples=40, deadline=None)
@given(parts=SENTENCES, size=st.integers(40, 90), overlap=st.integers(0, 15))
def test_pieces_cover_the_text(counts, parts, size, overlap):
    text = "".join(parts)
    numbers = counts.numbers(text)
    counts.learn()
    total = int(counts.tokens[numbers].sum())
    if total <= size:
        return
    pieces = cut_document(counts, text, numbers, size, overlap)
    assert pieces[0][0] == pieces[0][2] == 0 and (pieces[-1][1], pieces[-1][3]) == (total, len(text))
    for start, end, a, b, _ in pieces:
        assert 0 < end - start <= size and a < b
    for (_, end, _, stop, _), (start, _, begin, _, _) in zip(pieces, pieces[1:], strict=False):
        assert end - start == min(overlap, end) and begin <= stop


def test_an_edit_moves_neighbouring_cuts_only(counts):
    text = "".join(f"Sentence number {k} speaks of item {k * 7919 % 1000}. " for k in range(900))
    changed = text[:9000] + "One more sentence. " + text[9000:]
    ends = []
    for t in (text, changed):
        numbers = counts.numbers(t)
        counts.learn()
        ends.append({len(t) - p[3] for p in cut_document(counts, t, numbers, 120, 0)})
    late = {e for e in ends[0] if e < len(text) - 14000}
    assert len(late & ends[1]) >= 0.9 * len(late)


@pytest.mark.parametrize("size", [256, 512, 2048, 8192])
def test_edits_anywhere_leave_distant_cuts(counts, size):
    random = np.random.default_rng(size)
    stock = "the of a parser reads configuration internationalization x1 value tokenization queue responsibly and 42".split()
    sentences = [" ".join(random.choice(stock, random.integers(4, 18))).capitalize() + "." for _ in range(size * 3)]
    tokens = lambda t: (lambda n: (counts.learn(), int(counts.tokens[n].sum()))[1])(counts.numbers(t))
    same = later = 0
    for added in ("A " * 400 + "end.", "Antidisestablishmentarianism-pseudopseudohypoparathyroidism " * 40):
        for at in range(len(sentences) // 10, len(sentences), len(sentences) // 5):
            parts = sentences[:at], [added], sentences[at:]
            ends = []
            for chosen in (parts[0] + parts[2], parts[0] + parts[1] + parts[2]):
                text = " ".join(chosen)
                numbers = counts.numbers(text)
                counts.learn()
                ends.append((len(text), [(p[1], p[3]) for p in cut_document(counts, text, numbers, size, 0)]))
            safe = tokens(" ".join(parts[0])) - size
            assert [e for e in ends[0][1] if e[0] < safe] == [e for e in ends[1][1] if e[0] < safe]
            behind = [{length - end for _, end in cuts} for length, cuts in ends]
            late = [e for e in behind[0] if e < len(" ".join(parts[2])) * 0.5]
            same, later = same + len(behind[1].intersection(late)), later + len(late)
    assert same >= 0.9 * later


@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 10**6), size=st.integers(12, 60), overlap=st.integers(0, 5))
def test_no_piece_has_more_tokens_by_its_own_text(counts, seed, size, overlap):
    """Long words, words of several signs a token and ordinary text, each piece counted by the tokenizer."""
    random = np.random.default_rng(seed)
    stock = ["x" * 300, "日本語" * 40, "".join(chr(97 + k) for k in random.integers(26, size=400)), "🙂🙃" * 30, " and ", "\n\n", "a short sentence. ", "é" * 90]
    text = "".join(stock[k] for k in random.integers(len(stock), size=12))
    numbers = counts.numbers(text)
    counts.learn()
    total = int(counts.tokens[numbers].sum())
    assert total == len(counts.encoding.encode_ordinary(text))
    if total > size:
        pieces = cut_document(counts, text, numbers, size, overlap)
        assert pieces[-1][3] == len(text) and all(a[3] >= b[2] for a, b in zip(pieces, pieces[1:], strict=False))
        assert all(len(counts.encoding.encode_ordinary(text[a:b])) <= size for _, _, a, b, _ in pieces)


def test_pieces_of_real_documents_keep_to_edits(counts):
    """Appended, inserted and deleted text of another density in 40 long documents: pieces that don't touch the edit stay."""
    import pyarrow.parquet as pq

    texts = sorted((t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t), key=len)[-40:]
    random = np.random.default_rng(2)
    dense = " ".join("".join(chr(97 + k) for k in random.integers(26, size=14)) for _ in range(60))
    kept = far = 0
    for text in texts:
        at = int(random.integers(len(text)))
        for changed, low, high in ((text + "\n\n" + dense, len(text), 0), (text[:at] + dense + text[at:], at, len(text) - at), (text[:at] + text[at + 300 :], at, max(0, len(text) - at - 300))):
            cuts = []
            for t in (text, changed):
                numbers = counts.numbers(t)
                counts.learn()
                cuts.append([(p[2], p[3], len(t) - p[2], len(t) - p[3]) for p in cut_document(counts, t, numbers, 256, 32)])
            before, behind = {c[:2] for c in cuts[1]}, {c[2:] for c in cuts[1]}
            # neighbours: the piece with the edit, and the two after it, until a landmark brings the cuts together again
            edge = [k for k, c in enumerate(cuts[0]) if c[1] > low]
            late = edge[0] + 3 if edge else len(cuts[0])
            for k, c in enumerate(cuts[0]):
                if c[1] < low - 256 * 5 or k > late and c[2] < high:
                    far, kept = far + 1, kept + (c[:2] in before or c[2:] in behind)
    assert far > 500 and kept >= 0.95 * far


def test_a_text_of_exactly_the_capacity_is_not_split(spark, counts):
    word = "".join(chr(97 + k) for k in np.random.default_rng(1).integers(26, size=3000))
    text = f"see {word} end"
    size = len(counts.encoding.encode_ordinary(text))
    got = pack(spark.createDataFrame([(1, text), (2, "small")], "doc long, text string"), "doc", "text", [("p", size)]).collect()
    assert [r["n_tokens"] for r in got if r["doc"] == 1] == [size]
    assert cut_oversized(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text", [("p", size, 8)]).count() == 0


def test_oversized_only_and_bad_parameters(spark):
    frame = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, "word " * 200), (5, "y" * 4000)], "doc long, text string")
    got = cut_oversized(frame, "doc", "text", [("p", 50, 5)]).collect()
    assert {r["doc"] for r in got} == {4, 5}
    assert all(r["token_end"] - r["token_start"] <= 50 for r in got)
    with pytest.raises(ValueError):
        cut_oversized(frame, "doc", "text", [("p", 10, 9)])


@settings(max_examples=40, deadline=None)
@given(sizes=st.lists(st.integers(0, 50), max_size=40), seed=st.integers(0, 99))
def test_shard_packing_is_whole(sizes, seed):
    random = np.random.default_rng(seed)
    owner = random.integers(0, max(1, len(sizes)), 3 * len(sizes))
    terms = random.integers(0, 20, len(owner))
    sizes = np.array(sizes, dtype=np.int64)
    got = pack_shard(sizes, terms, np.ones(len(owner)), owner, np.ones(1 << 18), 10.0, 50)
    assert (got >= 0).all()
    assert all(sizes[got == c].sum() <= 50 for c in np.unique(got))
    # no two containers could be one, but for what neighbours were preferred to: at least half full on average
    if len(sizes) and sizes.sum():
        assert len(np.unique(got)) <= 2 * max(1, -(-int(sizes.sum()) // 50)) + 1


def test_packing_splits_only_what_exceeds(spark):
    frame = spark.createDataFrame([(1, "word " * 130), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (5, "other text")], "doc long, text string")
    got = pack(frame, "doc", "text", [("small", 50), ("large", 500)]).collect()
    for profile, capacity in (("small", 50), ("large", 500)):
        mine = [r for r in got if r["profile"] == profile]
        assert {r["doc"] for r in mine} == {1, 2, 3, 4, 5}
        assert len([r for r in mine if r["doc"] == 4]) == 1
        used = {}
        for r in mine:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert max(used.values()) <= capacity
        assert len([r for r in mine if r["doc"] == 1]) == (3 if capacity == 50 else 1)
    assert pack(frame.limit(0), "doc", "text", [("small", 50)]).count() == 0


def more_words_than_a_worker_keeps(spark):
    """500 texts of 1,000 words each that no other text has."""
    return spark.range(0, 500, 1, 1).selectExpr("id AS doc", "array_join(transform(sequence(id * 1000, id * 1000 + 999), x -> string(x)), ' ') AS text")


def test_sizes_hold_when_the_book_fills_within_a_batch(spark, counts, monkeypatch):
    monkeypatch.setattr(packing, "spread", lambda rows: rows.coalesce(1))
    frame = more_words_than_a_worker_keeps(spark)
    got = {r["doc"]: r for r in packing.sized(frame, "doc", "text", "byte_bpe_50k", W.TOKENIZERS).collect()}
    assert len(got) == 500
    for doc, text in frame.collect():
        assert got[doc]["n_tokens"] == len(counts.encoding.encode_ordinary(text))
        assert sorted(got[doc]["terms"]) == sorted({t for word in text.split(" ") for t in packing._terms_of(word)})


def test_pieces_hold_when_the_book_fills_within_a_batch(spark, counts, monkeypatch):
    monkeypatch.setattr(pieces, "spread", lambda rows: rows.coalesce(1))
    frame = more_words_than_a_worker_keeps(spark)
    got = {}
    for r in sorted(cut_oversized(frame, "doc", "text", [("p", 500, 0)]).collect(), key=lambda r: (r["doc"], r["piece_no"])):
        got.setdefault(r["doc"], []).append(r)
    for doc, text in frame.collect():
        assert "".join(r["text"] for r in got[doc]) == text
        assert got[doc][-1]["token_end"] == len(counts.encoding.encode_ordinary(text))
        assert all(len(counts.encoding.encode_ordinary(r["text"])) <= 500 for r in got[doc])


def test_shards_hold_what_retrieves_each_other(spark, monkeypatch):
    """Many small shards: texts of one subject meet, a subject larger than a shard is spread, nothing is lost."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 400)
    rows = [(f"d{k:04d}", f"the subject{k % 40} of report and {'more ' * (k % 7)}") for k in range(400)] + [(f"h{k:04d}", "hot hot words everywhere") for k in range(300)] + [("n", None)]
    frame = spark.createDataFrame(rows, "doc string, text string")
    got = pack(frame, "doc", "text", [("p", 64)]).collect()
    assert sorted(r["doc"] for r in got) == sorted(r[0] for r in rows)
    used, subjects = {}, {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        subjects.setdefault(r["container"], set()).add(r["doc"][0] + str(int(r["doc"][1:] or 0) % 40 if r["doc"][0] == "d" else ""))
    assert max(used.values()) <= 64
    assert len({r["container"].split("-")[1] for r in got}) > 8
    assert sum(r["how"] == "retrieved" for r in got) > sum(r["how"] == "size" for r in got)
