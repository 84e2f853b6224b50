"""What workers hold while several stages run in them."""

import sys

import public_tokenizers

from kerbline.llm import langid, packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_packing_keeps_fewer_words_than_token_files():
    assert packing.KEPT < tokens._KEPT
    encoder = tokens.kept_encoder(PATH, 3000)
    assert encoder is tokens.kept_encoder(PATH, 3000) and encoder is not tokens.kept_encoder(PATH)
    want = tokens.Encoder(PATH)
    for k in range(5):
        texts = [" ".join(f"word{k}x{i}" for i in range(40)).encode(), None]
        got, n = encoder(texts, 1)
        ids, m = want(texts, 1)
        assert got.tolist() == ids.tolist() and n.tolist() == m.tolist()
    assert encoder.n < 5 * 40 == want.n


def test_fitting_languages_frees_the_encoder_first():
    for task in (lambda: langid._pieces(iter([])), lambda: langid._count(iter([]), langid.ORDER)):
        tokens.kept_encoder(PATH, 3000)
        assert list(task()) == [] and "_kerbline_kept" not in sys.modules
