import hashlib
import random
import struct

import pytest

from quillmatch.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
SAMPLES = [
    None, "", " ", "\n\n  a\t b ", "Hello world, it's 2024! don't WE'LL", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>",
    "naïve café 東京 こんにちは 🙂🙂    z​\x1c\x85", "a" * 3000, "é" * 700, "=-" * 400, "0123456789" * 60, "  lead and trail  ", "the the the", "tab\tnew\r\nline   \n end",
]


def texts():
    rng = random.Random(4)
    letters = "abcdefgh THE the ing ß漢🙂'’.,!?0123\n\t "
    return SAMPLES + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(150)]


def test_against_library(spark):
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = bpe.token_digests(df, bpe.default_path()).collect()
    want = []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False).encode())))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def plain_merges(v, ids, data):
    """The pair of least rank first, the leftmost on ties."""
    out = [ids[data[i : i + 1]] for i in range(len(data))]
    while True:
        found = [(v.merges[x * v.size + y], i) for i, (x, y) in enumerate(zip(out, out[1:])) if x * v.size + y in v.merges]
        if not found:
            return out
        _, i = min(found)
        out[i : i + 2] = [ids[v.pieces[out[i]] + v.pieces[out[i + 1]]]]


def test_pairs_against_plain_merges():
    v = bpe.Vocabulary(bpe.default_path())
    ids = {p: i for i, p in enumerate(v.pieces) if i not in v.specials.values()}
    rng = random.Random(5)
    tokens = rng.sample(sorted(ids), 3000)
    assert [plain_merges(v, ids, t) for t in tokens] == [[ids[t]] for t in tokens]
    short = [t for t in ids if len(t) < 4]
    for _ in range(20_000):
        a, b = (rng.choice(short) if rng.random() < 0.8 else rng.choice(tokens) for _ in range(2))
        assert v.compatible(ids[a], ids[b]) == (plain_merges(v, ids, a + b) == [ids[a], ids[b]])


def library_ids(texts):
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 2000)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    v = bpe.Vocabulary(bpe.default_path())
    words = [f"w{i} x{i}" for i in range(40)]
    assert [v.encode([w])[0] for w in words] == library_ids(words)
    assert v.held <= 2000 + 1000 and len(v.words) < 20
    assert v.encode(words) == library_ids(words)


def test_long_texts(monkeypatch):
    """Texts beyond LETTERS go some words at a time; one endless word, many words, and special tokens between them."""
    monkeypatch.setattr(bpe, "LETTERS", 1000)
    monkeypatch.setattr(bpe, "WORDS", 7)
    rng = random.Random(6)
    long = ["ab" * 20_000, " ".join(f"word{rng.randrange(300)}" for _ in range(5000)), "<|endoftext|>".join("many words here " * 30 for _ in range(20)), "  \n" * 3000 + "é" * 999]
    v = bpe.Vocabulary(bpe.default_path())
    assert v.encode(long) == library_ids(long)


class Counted(dict):
    """A dict that counts what is looked up, and whose keys aren't gone through."""

    looked = 0

    def get(self, *a):
        self.looked += 1
        return super().get(*a)

    def keys(self):
        raise AssertionError("all keys are gone through")


def test_steps_of_the_walk():
    """A byte takes two steps of the automaton at most, however many tokens are begun at it; words known aren't gone through for each part."""
    rng = random.Random(7)
    words = sorted({" " + "".join(rng.choice(["th", "er", "in", "tion", "ou", "ed", "a", "s"]) for _ in range(rng.randrange(2, 9))) for _ in range(500)})
    v = bpe.Vocabulary(bpe.default_path())
    v.arcs, v.words = Counted(v.arcs), Counted()
    assert v.encode(words) == library_ids(words)
    assert v.arcs.looked <= 2 * sum(map(len, words))


def test_ascii_is_split_alike():
    import regex

    v, rng = bpe.Vocabulary(bpe.default_path()), random.Random(9)
    every = [chr(i) for i in range(128)]
    texts = ["".join(rng.choice(every) for _ in range(60)) for _ in range(1500)] + ["".join(rng.choice("'strvelmd STA01 \t\n.") for _ in range(60)) for _ in range(1500)]
    assert [v.find(t) for t in texts] == [regex.findall(bpe.PATTERN, t) for t in texts]


def test_tokens_that_end():
    v = bpe.Vocabulary(bpe.default_path())
    tokens = {p for i, p in enumerate(v.pieces) if i not in v.specials.values()}
    rng = random.Random(8)
    for token in rng.sample(sorted(tokens), 2000):
        i, found = v.pieces.index(token), []
        while i >= 0:
            found.append(v.pieces[i])
            i = v.shorter[i]
        assert found == [token[k:] for k in range(len(token)) if token[k:] in tokens]


def test_empty_table(spark):
    assert bpe.token_digests(spark.createDataFrame([], "doc_id long, text string"), bpe.default_path()).count() == 0


def test_parts_of_a_batch_are_small():
    """What a worker holds beside its batch goes with a part's letters."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["word " * 10_000] * 40})
    parts = [sum(map(len, p["text"].to_pylist())) for p in bpe.batches(iter([batch]), "text", bpe.LETTERS)]
    assert sum(parts) == 2_000_000 and max(parts) <= (1 << 18) + 50_000
