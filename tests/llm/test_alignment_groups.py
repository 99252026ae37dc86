"""A word that is one token of either side is one group, in which all is linked: it needs no transducer, which would say the same."""

import public_tokenizers as public

from lodestone.llm.alignment import GUARD, Aligner


def test_one_token_is_one_group(monkeypatch):
    at = Aligner(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    words = [" the", " internationalisation", " Zürich", "é", " 1234", "\n", " ", " ☃☃", " unbelievably", " xqzjkv", " <0x41>", " \u2581"]
    want, ones = {}, []
    for w in words:
        a = at.encoder.tokenizer.encode(w, add_special_tokens=False).ids
        b = at.sp.encode(GUARD + w)[2:]
        found = at.align((a, b), w.encode())
        if found is None:
            want[w] = ()
            continue
        groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[w] = (len(a), len(b), len(groups), text, b"".join(((x << 32) | y).to_bytes(8, "little") for x, y in links))
        if 1 in (len(a), len(b)):
            ones.append(w)
    assert dict(at.solve(words)) == want
    monkeypatch.setattr(at, "align", None)
    assert len(ones) > 2 and dict(at.solve(ones)) == {w: want[w] for w in ones}
