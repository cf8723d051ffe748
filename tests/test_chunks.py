from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.operators.chunk import overlap_chunks, tail

PAGE = st.text(alphabet="ab .\n한", max_size=900)


@settings(max_examples=150, deadline=None)
@given(st.lists(PAGE, min_size=1, max_size=8), st.integers(1, 120))
def test_overlap_invariants(pages, tokens):
    found = overlap_chunks(pages, tokens)
    bodies = "".join(text[offset:] for text, _, _, offset in found)
    assert "".join(bodies.split()) == "".join("".join(pages).split())
    assert all(1 <= a <= b <= len(pages) for _, a, b, _ in found)
    assert [a for _, a, _, _ in found] == sorted(a for _, a, _, _ in found)
    assert not found or found[0][3] == 0


def test_pages_of_chunks():
    found = overlap_chunks(["one " * 100, "", "two " * 100], 60)
    assert found[0][1:3] == (1, 1) and found[-1][1:3] == (3, 3)
    assert overlap_chunks([]) == [] and overlap_chunks([" ", ""]) == []
    assert overlap_chunks(["", "x"])[0][:3] == ("x", 2, 2)


def test_tail():
    assert tail("abcdef", 3) == "def"
    assert tail("aaaaaa. bb", 6) == "bb" and tail("aaaa. bbbb", 7) == "a. bbbb"
    assert tail("ab", 5) == "ab" and tail("", 3) == "" and tail("abc", 0) == ""
