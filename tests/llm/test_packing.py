import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from plansift.llm import packing as K


def check(rows, capacity=K.CAPACITY):
    """Sequences are gapless from offset 0 and within capacity; returns how many."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_equals_whole_text_tokens(spark, texts):
    rows = K.op8_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    tok = Tokenizer.from_file(K.tokenizer_path())
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for d, text in texts:
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            r = pieces.pop((d, k))
            part = ids[at:at + 4096]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    least = -(-sum(r.length for r in rows) // 4096)
    assert check(rows) <= least + 1


def test_parts_have_the_ids_of_the_text():
    tok = Tokenizer.from_file(K.tokenizer_path())
    for text in ("don't 're  <|endoftext|> á ́b   x y ΑΣ ΑΣ. \x1c1\x1d 12ab!? 你好 'S 'll", "Êtes-vous là, ÉÉ?! a.b,c 12,5 x_y (z) --",
                 "a×b é÷ü", "...end. # $%a", "<|ENDOFTEXT|> Aa", "ª º á. ", "\x00a\x7f, b", ""):
        parts = K.keys_of(text.encode())
        ids = K.part_ids(set(parts), K.tokenizer_path())
        assert b"".join(ids[p] for p in parts) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_bins_hold_every_piece_and_two_replace_one():
    # greedy takes 6 and 2 of ten; 2 gives way to 3 + 1
    assert K.plan_bins({6: 1, 3: 1, 2: 1, 1: 1}, 10)[0][0] == [6, 3, 1]
    assert K.plan_bins({6: 1, 5: 1, 3: 2}, 12)[0] == ([6, 5], 1) or K.plan_bins({6: 1, 5: 1, 3: 2}, 12)[0] == ([6, 3, 3], 1)
    rng = np.random.default_rng(3)
    sizes = Counter(rng.integers(1, 101, 5000).tolist())
    bins = K.plan_bins(sizes, 100)
    made = Counter()
    for filled, times in bins:
        assert sum(filled) <= 100
        for s in filled:
            made[s] += times
    assert made == sizes
    assert sum(t for _, t in bins) <= -(-sum(s * c for s, c in sizes.items()) // 100) + 30


def test_edges(documents, edge_rows):
    rows = K.pack_documents(documents(edge_rows)).collect()
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id in (1, 2, 3)}) == 3
    assert all(r.length == 1 for r in rows if r.doc_id in (1, 2, 3))
    assert sum(r.doc_id == 5 for r in rows) == 2 and max(r.piece for r in rows if r.doc_id == 8) > 50
    check(rows)
    assert K.pack_documents(documents([])).count() == 0
