import gzip
import hashlib
import io

import pytest

from tarsus.llm import warc


def test_splits_own_each_record_once(tmp_path):
    payloads = [b"x" * n for n in (0, 1, 99, 100, 5000)] + [bytes(range(256)) * 40, warc.MAGIC * 50, warc.record(1, "u", b"inner" * 50, None)]
    raw = b"".join(warc.record(i, f"http://a/{i}", p, None, level=0 if i % 2 else 6) for i, p in enumerate(payloads))
    whole = [d for _, d in warc.members(pa_file(raw), len(raw), 0, len(raw))]
    assert [warc.parse(d)["payload"] for d in whole] == payloads
    starts = [p for p, _ in warc.members(pa_file(raw), len(raw), 0, len(raw))]
    for step in (7, 64, 1000, 20_000):
        got = []
        for s in range(0, len(raw), step):
            got += [p for p, _ in warc.members(pa_file(raw), len(raw), s, min(s + step, len(raw)))]
        assert got == starts  # the record stored inside a record isn't one of them


def test_damage_and_padding_at_every_split():
    one = [warc.record(i, "u", b"payload %d " % i * 9, None, level=i % 2 * 6) for i in range(4)]
    broken = one[1][:40] + bytes([one[1][40] ^ 255]) + one[1][41:]
    cases = {
        b"".join(one) + bytes(20): [0, 1, 2, 3],
        bytes(13) + b"".join(one): [0, 1, 2, 3],
        one[0] + one[1] + b"\x1f\x8b\x08 damage" + one[2] + bytes(3) + one[3]: [0, 1, 2, 3],
        one[0] + broken + one[2] + one[3]: [0, 2, 3],
        one[0] + one[1] + one[2] + one[3][:-1]: [0, 1, 2],
        b"": [],
        b"not an archive": [],
    }
    for raw, want in cases.items():
        for at in range(0, len(raw) + 1, 3):
            got = [d for s, e in ((0, at), (at, len(raw))) for _, d in warc.members(pa_file(raw), len(raw), s, e)]
            assert [warc.parse(d)["page_id"] for d in got] == want


def test_look_is_enough_for_members_of_its_length():
    raw = b"".join(warc.record(i, "u", b"x%d" % i * 50, None) for i in range(30))
    starts = [p for p, _ in warc.members(pa_file(raw), len(raw), 0, len(raw))]
    for s in range(0, len(raw), 101):
        assert [p for p, _ in warc.members(pa_file(raw), len(raw), s, len(raw), look=400)] == [p for p in starts if p >= s]


def pa_file(raw):
    return _File(raw)


class _File:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_members_are_plain_gzip():
    data = gzip.GzipFile(fileobj=io.BytesIO(warc.record(3, "u", b"<p>hi</p>", None) + warc.record(4, None, b"", 3))).read()
    assert data.count(b"WARC/1.1") == 2 and b"WARC-Refers-To: <urn:x-page:3>" in data


@pytest.mark.parametrize("split", [50, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, split):
    long = "é" * 3000
    rows = [(5, "u", long), (2, "u v", long), (9, None, long), (9, None, long), (2, "u v", long), (1, "x", "short"), (3, "x", "short"), (4, "x", None), (6, "x", ""), (None, "n", long), (7, "y", "unique " * 50), (8, "y", "z" * 100), (10, "y", "z" * 100), (11, "y", "z" * 99), (12, "y", "z" * 99)]
    df = spark.createDataFrame([(a, b, c, "k", 0) for a, b, c in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(3)
    files = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read(files, split=split).collect()
    first = {}
    for a, _, c in rows:
        b = (c or "").encode()
        if len(b) >= 100 and a is not None:
            first[b] = min(first.get(b, a), a)
    want = []
    for a, _, c in rows:
        b = (c or "").encode()
        f = first.get(b)
        again = f is not None and (a is None or a > f)
        want.append((str(a), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(f if again else None), None if again else b))
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, warc.first_seen(df, salted=1).collect()), key=key) == sorted(map(tuple, warc.first_seen(df).collect()), key=key)
    assert warc.list_files(spark, f"file://{tmp_path}/w").count() == files.count()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(df, f"file://{tmp_path}/w")).collect() == []
