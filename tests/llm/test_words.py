"""Words of ASCII texts by their shorter way, as by the pattern."""

from seasonflow.llm import minhash


def test_words_as_by_the_pattern():
    texts = ["".join(map(chr, range(128))), "A_b-c 9\x1cd\x0be", "", "straße İx ñ_1", "\x00a\x7fb"]
    assert all(minhash.split_words(t) == minhash.WORD.findall(t.lower()) for t in texts)
