"""How often words are looked at, apart from the results."""

from __future__ import annotations

import pyarrow as pa
from test_models import small_lexicon

from ananym.llm import common, recurrent


def test_words_are_coded_without_the_space_between(monkeypatch):
    """Only words reach the dictionary, in the order in which they first occur."""
    seen = []
    monkeypatch.setattr(common, "tiles", lambda raw, edges, real=common.tiles: seen.append(len(edges) - 1) or real(raw, edges))
    codes, words, bounds = common.split_words(pa.array(["B a", None, "", "a\t\nB  c\v", "c", "é\x85x"]), lower=True)
    assert seen == [7]
    assert words == [b"b", b"a", b"c", "é\x85x".encode()]
    assert codes.tolist() == [0, 1, 1, 0, 2, 2, 3] and bounds.tolist() == [0, 2, 2, 2, 5, 6, 7]


def test_rare_codes_are_worked_out_once(monkeypatch):
    lexicon, calls = small_lexicon(), []
    monkeypatch.setattr(recurrent, "rare_class", lambda word, real=recurrent.rare_class: calls.append(word) or real(word))
    names = [f"zz{i}qx" for i in range(50)]
    codes, _, _, _ = recurrent.token_codes(pa.array([" ".join(names)]), lexicon)
    assert len(calls) == 1 and set(codes[:-1].tolist()) == {len(lexicon.head) + recurrent.zlib.crc32(b"qx") % recurrent.RARE}
