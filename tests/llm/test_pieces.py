import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm.pieces import KINDS, longest_stretch, split_oversized, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[fresh:stop] for _, fresh, stop, _, _ in pieces) == text
    tokens = text.split()
    if len(tokens) <= limit:
        assert len(pieces) == 1
        return pieces
    done = 0
    for i, (start, fresh, stop, size, _) in enumerate(pieces):
        words = text[start:stop].split()
        assert len(words) == size <= limit
        back = len(text[start:fresh].split())
        assert back == (min(overlap, done) if i else 0)
        assert words == tokens[done - back : done - back + size]
        done += size - back
    assert done == len(tokens)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["wort", "Ende.", "Abs.", "3", "(1)", "1.", "-", "\n", "\n\n", "\r\n", "§ 5 Titel", "\xa0", "ja;", "  "]), max_size=120), st.integers(2, 20), st.integers(0, 10))
def test_round_trip(parts, limit, overlap):
    check(" ".join(parts), limit, min(overlap, limit - 1))


def test_cuts_at_the_strongest_boundary():
    sentence = " ".join(["wort"] * 9) + " Ende. "
    text = ("(1) " + sentence * 3).strip() + "\n" + ("(2) " + sentence * 3).strip() + "\n" + ("(3) " + sentence * 3).strip()
    kinds = [KINDS[k] for *_, k in check(text, 40, 5)]
    assert kinds == ["paragraph", "paragraph", "section"]
    kinds = [KINDS[k] for *_, k in check(text, 30, 4)]
    assert set(kinds) <= {"paragraph", "sentence", "section"} and "sentence" in kinds


def test_abbreviations_and_numbers_end_no_sentence():
    text = " ".join(["gemäß § 3 Abs. 1 Nr. 2 vgl. § 4 am 5. Mai und"] * 10) + " Schluss. " + " ".join(["wort"] * 40) + "."
    for start, _, stop, _, kind in split_text(text, 50, 0)[:-1]:
        if KINDS[kind] == "sentence":
            assert text[start:stop].rstrip().endswith("Schluss.")


def test_siblings_are_merged():
    text = "\n".join(f"({i}) " + " ".join(["kurz"] * 4) + "." for i in range(40))
    pieces = check(text, 25, 0)
    assert len(pieces) == 8 and all(size == 25 for *_, size, _ in pieces)


def test_unbroken():
    assert longest_stretch("a b. c d e\nf") == 3
    r = random.Random(1)
    for _ in range(50):
        t = "".join(r.choice(["w ", "w, ", "w. ", "\n", "w; "]) for _ in range(60))
        assert longest_stretch(t) == max(len(x.split()) for x in re.split(r"[\n.;:!?]", t))


def test_rows(spark):
    long = " ".join(["wort"] * 300)
    rows = [(1, "kurz", 0), (2, None, 0), (3, "", 0), (4, long, 0), (5, "Satz mit Ende. " * 100, 0), (5, "Satz mit Ende. " * 100, 0), (6, "\xa0".join(["x"] * 257), 0)]
    df = spark.createDataFrame(rows, "id long, t string, piece_no int")
    got = split_oversized(df, "id", "t", 256, 32).collect()
    assert {r["id"]: r["unbroken"] for r in got} == {4: 1, 5: 0, 6: 1}
    assert sorted(r["piece_no"] for r in got if r["id"] == 4) == [1, 2]
    assert sum(r["id"] == 5 for r in got) == 4
    assert all(r["overlap"] == 32 for r in got if r["piece_no"] > 1)
    assert split_oversized(df.where("id > 9"), "id", "t").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "t", 10, 10)


def words(n, name="wort"):
    return " ".join([name] * n)


def test_no_piece_crosses_a_heading_unless_sections_are_whole():
    text = "# A\n" + words(300, "aa") + "\n# B\n" + words(20, "bb") + "\n# C\n" + words(20, "cc")
    pieces = [text[fresh:stop] for _, fresh, stop, _, _ in check(text, 256, 32)]
    assert ["aa" in p for p in pieces] == [True, True, False]
    assert "# B" in pieces[2] and "# C" in pieces[2] and "# B" not in pieces[1]


def test_headings_have_depth():
    text = "".join(f"# T{i}\n" + "".join(f"## U{i}{j}\n{words(30)}\n" for j in range(3)) for i in range(3))
    pieces = [text[fresh:stop] for _, fresh, stop, _, _ in check(text, 110, 0)]
    assert [p.split("\n")[0] for p in pieces] == ["# T0", "# T1", "# T2"]
    pieces = [text[fresh:stop] for _, fresh, stop, _, _ in check(text, 70, 0)]
    # a section that is too large leaves its last part alone
    assert [p.split("\n")[0] for p in pieces] == ["# T0", "## U02", "# T1", "## U12", "# T2", "## U22"]


def test_lists_nest():
    text = "\n".join(f"{i}. {words(5)}\n" + "\n".join(f"   {c}) {words(9)}" for c in "abc") for i in range(1, 7))
    pieces = [text[fresh:stop].strip() for _, fresh, stop, _, _ in check(text, 75, 0)]
    assert [p.split()[0] for p in pieces] == ["1.", "3.", "5."]
    kinds = [KINDS[k] for *_, k in check(text, 30, 0)]
    assert set(kinds) == {"item", "section"}
    html = "<ul>\n" + "\n".join(f"<li>{words(5)}\n<ul>\n<li>{words(9)}\n<li>{words(9)}\n</ul>" for _ in range(5)) + "\n</ul>"
    check(html, 30, 3)
