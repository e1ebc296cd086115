import numpy as np

from tarsus.llm import queries, tokens


def test_marks_that_compose_with_small_letters_only():
    t = tokens.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    texts = [f"An {c}{m}x {c}{m}. End" for c in map(chr, range(65, 91)) for m in [*map(chr, range(0x300, 0x370)), "\u0323\u030c", "\u05a5\u0331"]]
    texts += [x.lower() for x in texts]
    got = t.encode([x.encode() for x in texts])
    assert [b for b in got] == [np.array(e.ids, t.dtype).tobytes() for e in t.t.encode_batch(texts, add_special_tokens=False)]
