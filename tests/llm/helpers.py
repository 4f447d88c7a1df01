"""Small awkward tables and brute-force versions shared by the tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PROSE = ("the quick brown fox of the north and the lazy dog in a house by the sea that is not far from here "
         "and it was on a hill with trees as old as the village which lies at the foot of the mountain to be seen "
         "for miles when the sun goes down over the water and the boats come home with the catch of the day")
OTHER = ("die katze und der hund sind in dem haus das an der see liegt und von dort ist es nicht weit zu dem berg "
         "auf dem die alten eichen stehen und ein weg führt durch das tal in die stadt mit den vielen türmen für "
         "alle die das land sehen wollen wenn die sonne im westen über dem wasser untergeht und es still wird")


def awkward_rows(long_words: int = 30000):
    """(doc_id, text, lang, source, n_chars, size, rank): nulls, empties, repeats, ties, one very long text."""
    long_text = " ".join(f"w{i % 977} {PROSE.split()[i % 60]}" for i in range(long_words // 2))
    texts = [
        (1, PROSE, "en", "b"), (2, PROSE, "en", "b"), (3, PROSE + " again", "en", None), (4, None, "en", "a"),
        (5, "", None, "a"), (6, " \t\n\x0b\r ", "de", "c"), (7, OTHER, "de", "c"), (8, OTHER.upper(), "de", "c"),
        (9, "one two three", "en", "a"), (10, "One  two\nthree", "en", "a"), (11, long_text, "en", "b"),
        (12, "日本語 のテキスト だけ", None, None), (13, "1234 5678 !!!", "en", "a"), (14, OTHER + " " + PROSE, None, "c"),
        (15, "a b a b a b a b", "en", "a"), (15, "a b a b a b a b", "en", "a"), (None, "no id here", "en", "a"),
        (16, PROSE.replace("quick", "slow"), "en", "b"),
    ]
    return [(i, t, lg, s, len(t) if t else None, -1, "x") for i, t, lg, s in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string"


def awkward(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)])


def smallest_reachable(ids, linked):
    """id -> smallest id reachable over ``linked(a, b)``."""
    ids = sorted(ids)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if linked(ids[x], ids[y]):
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
