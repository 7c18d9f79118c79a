"""Texts and ids that real tables hold: long runs of one character, ids that repeat with different texts."""

import random
from collections import Counter, defaultdict

import pytest

from freshet.llm import jaccard, packing, tokens
from test_llm import brute_components, prose, table


def test_long_runs_encode_as_the_whole():
    """Runs that the pattern can still take give the same ids when they are encoded by themselves."""
    encoder = tokens._encoder(tokens.VOCABULARY)
    rng = random.Random(1)
    for run in (" ", "\n", "\t", "\r\n", "　", " \n", "\xa0"):
        n = tokens.LONG_RUN // len(run) + rng.randint(0, 5)
        for text in (run * n, "ab" + run * n, run * n + "ab", "x" + run * n + "9" + run * n + "!", run * n + " ab\n", "ab" + run * n + "你"):
            assert [t for part in encoder.parts(text) for t in part] == encoder.pattern.encode_ordinary(text), repr((run, n))


@pytest.mark.parametrize("run", [" ", "\n", "a", "7", "!"])
def test_any_text_is_counted_and_packed(spark, run):
    """5 MB of one character: ids decode to the text, lengths and pieces agree."""
    rows = [(1, run * 5_000_000), (2, "word " + run * 1_200_000 + " word"), (3, "word")]
    docs = table(spark, rows)
    lengths = {r.doc_id: r.n_tokens for r in tokens.encoded_lengths(docs).collect()}
    encoder = tokens._encoder(tokens.VOCABULARY)
    packed = defaultdict(int)
    for r in packing.pack(tokens.encoded(docs)).select("doc_id", "n_tokens").collect():
        packed[r.doc_id] += r.n_tokens
    for i, text in rows:
        ids = [t for part in encoder.parts(text) for t in part]
        assert encoder.pattern.decode(ids) == text
        assert lengths[i] == len(ids) and packed[i] == len(ids) + 1


def test_similar_groups_take_rows_of_one_id_as_one_node(spark):
    a, b, c = (prose(random.Random(k), 30) for k in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (11, a + " x"), (12, b + " y"), (None, a)]
    got = jaccard.similar_groups(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 5, 80, 100)


def groups_of(rows):
    """Components of rows by their own texts, each row a node."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    return [c for _, _, c in sorted(brute_components(numbered, 5, 80, 100))]


@pytest.mark.parametrize("seed", range(2))
def test_keep_one_with_repeated_ids(spark, seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 12, 40])) for _ in range(8)]
    texts += [t + " end" for t in texts[:4]] + ["", None]
    rows = [(rng.choice([1, 2, 3, 4, 5, *range(10, 40)]), rng.choice(texts)) for _ in range(60)]
    rows += [(1, texts[0]), (1, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1])]
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(table(spark, rows)).collect())
    assert not kept - Counter(rows)
    often = Counter(i for i, _ in rows)
    groups = defaultdict(list)
    for (i, t), g in zip(rows, groups_of(rows)):
        groups[g if (t or "").split() else (g, "no words")].append((i, t))
    for members in groups.values():
        stay = Counter(members) & kept
        kept -= stay
        if not (members[0][1] or "").split():
            assert stay == Counter(members)
            continue
        single = sorted(m for m in members if often[m[0]] == 1)
        assert sum(stay.values()) == 1, (members, stay)
        if single:
            assert [*stay] == single[:1]
    assert not kept


def test_keep_one_of_the_reported_rows(spark):
    a, b, c = (prose(random.Random(k), 30) for k in range(3))
    kept = jaccard.keep_one(table(spark, [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (None, a)])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (7, b), (9, c), (None, a)], key=str)
