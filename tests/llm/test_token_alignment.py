import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from corpus_fixtures import LONG, TEXTS, documents, empty, rows
from tidemark.llm import token_alignment as t

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_of(letter):
    """Published rule of byte-level vocabularies, the other way round."""
    if 0x21 <= ord(letter) <= 0x7E or 0xA1 <= ord(letter) <= 0xAC or 0xAE <= ord(letter) <= 0xFF:
        return ord(letter)
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return hidden[ord(letter) - 256]


@pytest.fixture(scope="module")
def encode():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def one(text):
        """(id, bytes) of the tokens of A and of B, the text encoded as a whole."""
        if not text:
            return None
        of_a = [(i, bytes(map(byte_of, a.id_to_token(i)))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = [
            (i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
            for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))
        ]
        data = b" " + text.encode()
        return (of_a, of_b) if b"".join(x for _, x in of_a) == data == b"".join(x for _, x in of_b) else None

    return one


def spans(tokens):
    end, out = 0, []
    for i, data in tokens:
        out.append((i, end, end + len(data)))
        end += len(data)
    return out


def brute(texts, encode):
    found = []
    for doc_id, text in texts:
        both = encode(text)
        if both is None:
            found.append((doc_id, 0, 0, None, []))
            continue
        a, b = map(spans, both)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, begin = [], 0
        for cut in cuts:
            parts = []
            for side in (left := [iter(a), iter(b)] if not begin else left):
                own = []
                for i, s, e in side:
                    own.append(str(i))
                    if e == cut:
                        break
                parts.append(",".join(own))
            groups.append("|".join(parts))
            begin = cut
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        found.append((doc_id, len(a), len(b), groups, links))
    counts = Counter(x for *_, links in found for x in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        text = ";".join(groups) if groups else None
        out.append((
            doc_id, n_a, n_b, len(groups or []), len(links), sum(counts[x] == most[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def aligned(spark, texts, **how):
    found = t.align(documents(spark, texts), A, B, **how)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rows(found)


SHORT = [(i, x if x is None or len(x) < 5000 else x[:1500]) for i, x in TEXTS]
MORE = SHORT + [
    (100, "a <|endoftext|> b <s> </s> <unk> <0x41>"), (101, "a ▁ b"), (102, "▁"), (103, "it's  we'll\tdon't \n\n  x \r\n y"), (104, " lead and trail "),
    (105, "日本語のテキスト、空白なし。" * 20), (106, "\x00 \x1c a\x1cb \x85   c"), (107, "é ﬁ ﷺ ㎏ ​ x"), (108, "👩‍👩‍👧 🏳️‍🌈 fin"), (109, "1234567 890 x" * 30),
    (110, "        many    spaces        "), (111, "Hello world " * 50), (112, " "), (113, "\n"), (114, "camelCase snake_case kebab-case " * 20),
]


@pytest.mark.parametrize("how", [{}, {"long": 40}, {"long": 3}, {"pairs_limit": 30}, {"pairs_limit": 0, "long": 100}])
def test_against_whole_encodings(spark, encode, how):
    assert aligned(spark, MORE, **how) == brute(MORE, encode)


def test_tree_of_several_levels(spark, encode, monkeypatch):
    monkeypatch.setattr(t, "FAN", 2)
    texts = [(1, LONG[:1200]), (2, "x" * 700), (3, "日本" * 200), (4, None), (1, LONG[:1200])]
    assert aligned(spark, texts, long=16) == brute(texts, encode)


def test_vocabularies_without_safe_places(spark, encode, monkeypatch):
    """Then a text is encoded as a whole; the result is the same."""
    old = t.Pair.__init__

    def made(self, *paths):
        old(self, *paths)
        self.cuts = False

    pair = t.Pair(A, B)
    assert pair.cuts and pair.pieces("a b  c\n d") == ["a", "b  c\n d"]
    monkeypatch.setattr(t.Pair, "__init__", made)
    known = t.Pieces(t.Pair(A, B))
    texts = [x for _, x in MORE]
    found = [p if p is None else known.counts[p].sum(axis=0).tolist() for p in known.documents(texts)]
    want = [r if (r := encode(x)) is None else [len(r[0]), len(r[1])] for x in texts]
    assert found == want


def test_a_task_that_forgets(spark, encode, monkeypatch):
    monkeypatch.setattr(t, "_PIECES", 5)
    assert t.Pieces(t.Pair(A, B)).full is False
    assert aligned(spark, MORE[:20]) == brute(MORE[:20], encode)


def test_composition_is_associative(encode):
    """Any bracketing of the ranges of a text gives the same fragment and the same closed groups."""
    text = "Some words, 日本語のテキスト and more wordstogether " * 6
    a, b = (t.Tokens(np.array([i for i, *_ in s]), np.array([e for *_, e in s])) for s in map(spans, encode(text)))
    writer = t.Writer(50257, 32000)
    rng = random.Random(3)

    def content(fragment, closed):
        text = b"".join(x for *_, x in sorted(closed))
        return [v.tolist() for v in (*fragment.left, *fragment.right)], fragment.first, text

    size = 5
    leaves = [t.fragment_of(n, a.part(n * size, n * size + size), b.part(n * size, n * size + size), writer) for n in range(-(-int(a.ends[-1]) // size))]
    assert any(f.first is None for f, _ in leaves)
    seen = set()
    for _ in range(30):
        parts = list(leaves)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            (x, closed_x), (y, closed_y) = parts[i], parts[i + 1]
            whole, closed = x + y
            parts[i:i + 2] = [(whole, closed_x + closed_y + closed)]
        seen.add(str(content(*parts[0])))
    assert len(seen) == 1
    whole, closed = parts[0]
    assert not len(whole.right[0]) and not len(whole.right[1])
    first = t.group_text(*whole.left)
    assert first + b"".join(x for *_, x in sorted(closed)) == writer.text(a, b, t.cuts_of(a, b))[0]


def test_a_third_of_all_rows_are_one_text(spark, encode):
    texts = [(i, MORE[-1][1] if i % 3 == 0 else f"text {i} of {i * i}") for i in range(90)]
    assert aligned(spark, texts, pairs_limit=50) == brute(texts, encode)


def test_very_long_text(spark, encode):
    texts = [(1, LONG), (2, "word " * 5), (3, "y" * 40_000)]
    assert aligned(spark, texts) == brute(texts, encode)


def test_empty(spark):
    assert t.align(empty(spark), A, B).count() == 0
    assert aligned(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
