import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import got
from tracelake.llm import truncation as K

WHOLE = [
    "# Background\nThe job that closes orders runs at night and skips others. Older clients still send the invoice without a reference.",
    "Older clients still send the invoice without a reference. Call log 77 was marked as truncated, so its facts stay low.\n- keep the wallet column\n- keep the order column",
    "Older clients still send the parcel without a reference. The job that closes parcels runs at night and skips others.\nStatus: settled",
    "Call log 1 was marked as truncated, so its facts stay low. Older clients still send the order without a reference.\n```json\n{\"a\": 1}\n```",
    "夜间任务会跳过已冻结的记录。手续费在审批之后统一计算一次。该规则从第5版开始生效。",
    "手续费在审批之后统一计算一次。夜间任务会跳过已冻结的记录。\n# Background",
    "手续费在审批之后统一计算一次。Das Protokoll zählt jeden Lauf getrennt.\n| a | b |",
    "Das Protokoll zählt jeden Lauf getrennt. Das Protokoll zählt jeden Lauf getrennt.\n| a | c |\nStatus: settled",
    "Das Protokoll zählt jeden Lauf getrennt.\n\nBackground",
]
CUT = [
    "Fine. Older clients still send the invo", "Fine. Older clients still send the", "Call log 5 was marked as trunc…", "The job that closes orders runs at night and [cut]", "夜间任务会跳过已冻", "手续费在审批之后统�",
    "Fine.\nDas Protokoll zählt jed  \n", "Das Protokoll zählt (continued)", "- keep the wal", "Call log 1234 was marked as truncated, so its...",
]


def test_cases(rows):
    data = [(i, t, "x", "y") for i, t in enumerate(WHOLE * 2)] + [(100 + i, t, "x", "y") for i, t in enumerate(CUT)] + [(50, None, "", ""), (51, "  ", "", ""), (None, CUT[0], "", ""), (100, CUT[0], "", "")]
    found = K.cut_texts(rows(data, "doc_id long, text string, unit string, n string"))
    assert got(found) == [(100 + i,) for i in range(len(CUT))]


@pytest.mark.parametrize("copies", [3, 1000])
@pytest.mark.parametrize("marks", [("",), (" [cut]",), ("…",), ("", "…", " [cut]", "  ")])
def test_copies_of_a_cut_text_are_no_witnesses(rows, copies, marks):
    data = [(i, t) for i, t in enumerate(WHOLE)]
    cuts = [(1000 + i, "Fine. Older clients still send the invo" + marks[i % len(marks)]) for i in range(copies)]
    cuts += [(5000 + i, "Call log 5 was marked as truncated, so its" + marks[i % len(marks)]) for i in range(copies)]
    assert got(K.cut_texts(rows(data + cuts, "doc_id long, text string"))) == [(i,) for i, _ in cuts]


@pytest.mark.parametrize(
    "text, last, open_, marked",
    [
        ("One. Two", "Two", True, False), ("One. Two.", "Two .", False, False), ("One. Tw…", "Tw", True, True), ("One. Two. [more]", "Two .", False, True), ("a\n```\nx\n```", "` ` `", False, False),
        ("a\n```\nx", "x", True, False), ("...", None, False, False), ("(steward, on duty)", "( steward , on duty )", True, False), ("No 12", "No 0", True, False), ("完成。", "完 成 。", False, False),
    ],
)
def test_units(text, last, open_, marked):
    assert K.units(text)[1:] == (last, open_, marked)


def test_shares(rows):
    docs = rows([(1, "A "), (2, "a"), (3, None), (4, "b"), (2, "a")], "doc_id long, source string")
    assert got(K.cut_shares(docs, rows([(2,)], "doc_id long"))) == [("a", 3, 2, 2 / 3), ("b", 1, 0, 0.0), (None, 1, 0, 0.0)]


def test_no_rows_and_long_texts(rows):
    assert K.cut_texts(rows([], "doc_id long, text string")).count() == 0
    long = "word and more of it " * 20_000
    assert got(K.cut_texts(rows([(1, long + "."), (2, long), (3, "x" * 300_000)], "doc_id int, text string")), "doc_id") in ([], [(2,)])


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "…", ".", "..", "-", "--", ">", "[cut]", "(more)", "<read more here>", "[", "]", "wort", "a.", "[…]", "(..)", "�", "~", ")"]), max_size=9).map("".join))
def test_marks_are_stripped_from_the_end(text):
    assert K.stripped(text) == K.MARKS.sub("", text)


def test_words_of_any_length(rows):
    """A cut inside a very long word is seen too."""
    name = "a" * 70 + "bcdefghij" * 30
    data = [(i, f"The key is {name} and it ends here.") for i in range(4)] + [(10, f"Fine. The key is {name[:200]}"), (11, f"Fine. The key is {name[:71]}"), (12, "The key is " + "a" * 64)]
    data = [(i, t + (f" Another {i} one." if i < 4 else "")) for i, t in data]
    assert got(K.cut_texts(rows(data, "doc_id long, text string"))) == [(10,), (11,), (12,)]


def test_contexts_met_by_a_shuffle_decide_alike(rows, monkeypatch):
    data = rows([(i, t) for i, t in enumerate(WHOLE * 2)] + [(100 + i, t) for i, t in enumerate(CUT)], "doc_id long, text string")
    found = got(K.judged_texts(data))
    monkeypatch.setattr(K, "SENT_CONTEXTS", 0)
    assert got(K.judged_texts(data)) == found and len(found) == len(CUT)
