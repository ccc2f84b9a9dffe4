import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from facetry.llm.line_dedup import MIN_DOCS, line_dedup, op4_line_dedup
from tests.llm import fixtures


def brute(texts, min_docs):
    """The rule in force with strings and fractions instead of hashes and whole numbers, one document after the other: kept lines of each."""

    def forms(line):
        t = ["*" if any("0" <= c <= "9" for c in x) else x for x in line.split()]
        out = [("exact", tuple(t))] if t else []
        if len(t) >= 8:
            half = 2 + (len(t) - 2) // 2
            for kind, test in (("even", lambda i: i % 2 == 0), ("odd", lambda i: i % 2 == 1), ("front", lambda i: i < half), ("back", lambda i: i >= half)):
                out.append((kind, tuple("*" if i >= 2 and test(i) else x for i, x in enumerate(t))))
        return out

    docs = []  # for each document its different lines by their exact form: (all forms, characters)
    for text in texts:
        lines = {}
        for line in (text or "").split("\n"):
            own = forms(line)
            if own:
                lines[own[0]] = own, len(line) + (lines[own[0]][1] if own[0] in lines else 0)
        docs.append(list(lines.values()))
    in_docs = Counter(g for lines in docs for g in {g for own, _ in lines for g in own})
    weight = Counter()
    for lines in docs:
        # characters that no other document has, then the rarer lines until a quarter of the text is covered
        shared = sorted((max(in_docs[g] for g in own), size) for own, size in lines if max(in_docs[g] for g in own) > 1)
        total = sum(size for _, size in lines)
        covered, q = total - sum(size for _, size in shared), 1
        for n, size in shared:
            if 4 * covered >= total:
                break
            covered, q = covered + size, n
        for g in {g for own, _ in lines for g in own}:
            weight[g] += Fraction(1, q)

    def needed(g):
        fixed = sum(x != "*" for x in g[1])
        return min_docs if fixed <= 10 else max(math.ceil(Fraction(min_docs * 10, fixed)), min(2, min_docs))

    gone = {g for g, w in weight.items() if in_docs[g] > 1 and w >= needed(g)}
    return [[] if t is None else [x for x in t.split("\n") if not gone & set(forms(x))] for t in texts]


def made(rng):
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    prose = lambda: " ".join(word() + str(rng.choice(["", ""])) + rng.choice("xyz") * 3 for _ in range(rng.randint(1, 14)))
    texts = []
    for i in range(120):
        lines = [prose() for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "All rights reserved.")
        if i % 4 == 0:
            lines.insert(0, f"Posted at 1{i}:{i} by user{i} via web")
        if i % 5 == 0:
            lines.append(f"Dear reader {prose().split()[0]}, thank you so much for your visit")
        texts.append("\n".join(lines))
    return texts + [texts[0]] * 6 + [None, "", "\n\n", "one", "All rights reserved.\nAll rights reserved.", "w " * 50_000]


def test_against_brute_force(spark):
    texts = made(random.Random(4))
    got = {r["doc_id"]: r for r in line_dedup(fixtures.docs(spark, texts).repartition(7), min_docs=8).collect()}
    kept = brute(texts, 8)
    want = [None if t is None else "\n".join(k) for t, k in zip(texts, kept)]
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert any("Dear" in (t or "") for t in texts) and not any("Dear" in (t or "") or "Posted" in (t or "") or "rights" in (t or "") for t in want)
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t.split("\n"))
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (n, n - len(kept[i]))


@pytest.mark.parametrize("seed, min_docs", [(1, 2), (2, 4), (3, 7), (4, 10)])
def test_against_brute_force_where_texts_share_much(spark, seed, min_docs):
    rng = random.Random(seed)
    short = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(14)]
    long = [" ".join(own_lines(rng, n)) for n in (2, 3, 5, 8, 9)]
    fields = lambda: f"seen {rng.randint(1, 99)} times by {rng.choice('uvwxyz')} near the old mill of {rng.choice('uvwxyz')}"
    texts = []
    for _ in range(150):
        lines = rng.choices(short, k=rng.randint(0, 5)) + rng.choices(long, k=rng.choice([0, 0, 1])) + own_lines(rng, rng.randint(0, 3))
        lines += [fields()] if rng.random() < 0.3 else []
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[i] for i in rng.choices(range(150), k=40)]
    texts += [texts[i] + "\n" + own_lines(rng, 1)[0] for i in rng.choices(range(150), k=20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup(fixtures.docs(spark, texts).repartition(6), min_docs=min_docs).collect()}
    want = ["\n".join(k) for k in brute(texts, min_docs)]
    assert [got[i] for i in range(len(texts))] == want
    changed = sum(a != b for a, b in zip(texts, want))
    assert 0 < changed < len(texts)


def test_copied_texts_keep_their_lines(spark):
    texts = ["first line of a text\nsecond line of it\nthird"] * 50
    got = line_dedup(fixtures.docs(spark, texts), min_docs=2).collect()
    assert all(r["n_dropped"] == 0 for r in got)


def test_query_nulls_and_empty(spark, tmp_path):
    texts = [None, None, *[f"own {'abc'[i % 3]}{'xyzuvw'[i // 3]} end\nshared boilerplate" for i in range(18)]]
    docs = fixtures.docs(spark, texts, ids=[None, None, *range(18)]).withColumnRenamed("n_chars", "g")
    got = op4_line_dedup(spark, fixtures.write(spark, tmp_path, documents=docs)).collect()
    assert len(got) == 20 and sum(r["n_dropped"] for r in got) == 18 >= MIN_DOCS
    assert sorted((r["n_lines"], r["n_chars"]) for r in got if r["doc_id"] is None) == [(0, None), (0, None)]
    assert op4_line_dedup(spark, fixtures.write(spark, tmp_path / "e", documents=docs.limit(0))).count() == 0


def own_lines(rng, n):
    return [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(6)) for _ in range(n)]


def test_copies_of_one_text_do_not_save_a_line_elsewhere(spark):
    rng = random.Random(5)
    common = "Share this article with your friends"
    copied = "\n".join([*own_lines(rng, 2), common, *own_lines(rng, 2)])
    texts = ["\n".join([*own_lines(rng, 2), common, *own_lines(rng, 1)]) for _ in range(30)] + [copied] * 200
    got = {r["doc_id"]: r for r in line_dedup(fixtures.docs(spark, texts).repartition(5)).collect()}
    assert all(got[i]["text"] == "\n".join(x for x in t.split("\n") if x != common) for i, t in enumerate(texts))


def test_blocks_of_lines_go_wherever_they_stand(spark):
    rng = random.Random(6)
    block = ["Home and News and Contact", "Terms of use apply here", "Written for all our readers", "Follow us on every channel"]
    texts = []
    for i in range(36):
        lines = own_lines(rng, 4)
        lines[(0, 2, 4)[i % 3] : (0, 2, 4)[i % 3]] = block[: 2 + i % 2 * 2] if i % 3 == 1 else block
        texts.append("\n".join(lines))
    for texts in (texts[0::3], texts[1::3], texts[2::3]):  # at the start, inside, at the end
        got = {r["doc_id"]: r for r in line_dedup(fixtures.docs(spark, texts).repartition(5), min_docs=6).collect()}
        assert all(got[i]["text"] == "\n".join(x for x in t.split("\n") if x not in block) for i, t in enumerate(texts))


def test_copies_with_small_edits_keep_their_lines(spark):
    rng = random.Random(7)
    base = own_lines(rng, 10)
    texts = []
    for i in range(40):
        lines = list(base)
        lines[i % 10] = own_lines(rng, 1)[0]
        texts.append("\n".join(lines))
    assert all(r["n_dropped"] == 0 for r in line_dedup(fixtures.docs(spark, texts).repartition(5)).collect())


def test_long_passages_need_fewer_texts(spark):
    rng = random.Random(8)
    passage, middle, short = (" ".join(own_lines(rng, n)) for n in (10, 5, 1))  # 60, 30 and 6 tokens
    texts = ["\n".join([*own_lines(rng, 8), *[x for x, n in ((passage, 2), (middle, 4), (short, 9)) if i < n], *own_lines(rng, 8)]) for i in range(12)]
    other = " ".join(own_lines(rng, 10))
    copied = "\n".join([*own_lines(rng, 2), other])
    texts += [copied] * 5
    got = {r["doc_id"]: r for r in line_dedup(fixtures.docs(spark, texts).repartition(5)).collect()}
    assert all(got[i]["text"] == "\n".join(x for x in t.split("\n") if x not in (passage, middle)) for i, t in enumerate(texts))
