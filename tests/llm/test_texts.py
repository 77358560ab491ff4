"""Transport streams, rule ledger, byte BPE, token files: against brute force on odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from fuzzloom.llm import byte_bpe, rule_ledger, token_files, transport_stream

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def keyed(rows):
    return sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def in_order(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def test_transport_stream_round_trip(odd, odd_rows, none):
    got = in_order(transport_stream.media_digest(odd))
    for row, (doc_id, text) in zip(got, keyed(odd_rows), strict=True):
        assert row["doc_id"] == doc_id
        for k, v in transport_stream.brute_force(text).items():
            assert row[k] == v
        assert row["feature"].startswith("ok=true") and row["feature"].endswith("gaps=0")
    assert transport_stream.media_digest(none).count() == 0


def test_transport_stream_faults():
    payload = bytes(range(256)) * 300
    media = bytearray(transport_stream.mux(payload))
    whole = transport_stream.demux(bytes(media))
    assert whole["payload"] == payload and [x[0] for x in whole["timeline"]] == [90_000 + 3600 * k for k in range(5)]
    assert whole["streams"] == [(0x100, 6)] and whole["pmt_pid"] == 0x1000
    n = transport_stream.PACKET
    lost = transport_stream.demux(bytes(media[: 20 * n] + media[21 * n :]))
    assert lost["gaps"] == 1 and not lost["ok"]
    again = transport_stream.demux(bytes(media[: 21 * n] + media[20 * n :]))
    assert again["repeats"] == 1 and again["ok"] and again["payload"] == payload
    media[10] ^= 1  # a table whose CRC is wrong
    assert not transport_stream.demux(bytes(media[: 40 * n]))["ok"]
    for bad in (None, b"", b"\x47" * 100, bytes(188)):
        assert not transport_stream.demux(bad)["ok"]


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered)}


def test_rule_ledger(odd, odd_rows, none):
    got = in_order(rule_ledger.verdicts(odd))
    for row, (doc_id, text) in zip(got, keyed(odd_rows), strict=True):
        want = slow_measure(text)
        assert {k: row[k] for k in want} == want and row["doc_id"] == doc_id
        assert row["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (row["base_failed"] and row["kept"])
    assert rule_ledger.verdicts(none).count() == 0
    kept = rule_ledger.keep_passing(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)


def test_rule_ablation(odd):
    ledger = rule_ledger.evaluate(odd, ["doc_id"])
    bits = [r["failed_bits"] for r in ledger.collect()]
    mask = rule_ledger.policy_mask("v2")
    got = {r["rule"]: r for r in rule_ledger.ablation(ledger, "v2").collect()}
    assert set(got) == set(rule_ledger.POLICIES["v2"])
    for rule in rule_ledger.RULES:
        if rule.name in got:
            b = 1 << rule.bit
            assert got[rule.name]["n_fail"] == sum(bool(x & b) for x in bits)
            assert got[rule.name]["n_only"] == sum(x & mask == b for x in bits)
            assert got[rule.name]["kept_without"] == sum(not x & mask & ~b for x in bits)


def test_byte_bpe_as_the_library(odd, odd_rows, none):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    got = sorted(byte_bpe.round_trip(odd, RANKS, P.PATTERN, 8).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for row, (doc_id, text) in zip(got, keyed(odd_rows), strict=True):
        ids = own.encode_ordinary(text)
        assert (row["doc_id"], row["n_tokens"]) == (doc_id, len(ids))
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_byte_bpe_encode_decode(odd, odd_rows):
    ids = byte_bpe.encode(odd, RANKS, P.PATTERN, 4)
    back = Counter((r[0], bytes(r[1])) for r in byte_bpe.decode(ids, RANKS).collect())
    assert back == Counter((a, b.encode()) for a, b in keyed(odd_rows))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, odd_rows, none, encoding, tmp_path):
    from tokenizers import Tokenizer

    own, start = Tokenizer.from_file(WORDS), 0
    got = token_files.token_digest(odd, WORDS, 2, encoding).orderBy("start").collect()
    for row, (doc_id, text) in zip(got, keyed(odd_rows), strict=True):
        ids = own.encode(text, add_special_tokens=False).ids + [2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.token_digest(none, WORDS).count() == 0
    token_files.write_tokens(odd, WORDS, 2, str(tmp_path / "t"), encoding, files=3)
    some = token_files.read_tokens(spark, str(tmp_path / "t"), 5, 9).collect()
    assert sorted({r["doc_id"] for r in some}) == [5, 6, 7, 8]
    meta = token_files.read_metadata(spark, str(tmp_path / "t"))
    assert ",tokens" not in meta._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["start"]) for r in some} <= {(r["doc_id"], r["start"]) for r in meta.collect()}


def test_bad_encoding(odd):
    with pytest.raises(ValueError):
        token_files.write_tokens(odd, WORDS, 2, "/nowhere", "plain")


def test_ranks_file():
    ranks = byte_bpe.load_ranks(RANKS)
    first = next(iter(open(RANKS, "rb"))).split()
    assert ranks[base64.b64decode(first[0])] == int(first[1]) and len(ranks) == 50256
