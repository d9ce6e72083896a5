"""Secrets in repeated, escaped, wrapped and compressed stretches."""

import base64
import gzip
import random
import re

from lectern.llm import secrets

SECRET = "password=hunter2hunter2"


def found(text):
    base, every, given_up = secrets.read_all(text)
    return [x for x in every if x not in base], given_up


def test_one_secret_at_two_places():
    hidden = base64.b64encode(f"note {SECRET} end".encode()).decode()
    for layer in (hidden, base64.b64encode(hidden.encode()).decode(), base64.b64encode(gzip.compress(SECRET.encode())).decode()):
        text = f"line {layer}\nline {layer}\n"
        spans, _ = found(text)
        assert len(spans) == 2 and spans[0][2] <= text.index("\n") < spans[1][0], layer


def test_key_blank_and_escaped_value():
    for text in (r'"password": "\u0068unter2secret"', "token = %61bcdef12", r"api_key = \x61\x62\x63\x64\x65\x66"):
        (a, kind, b), *_ = found(text)[0]
        assert kind == 0 and a == text.index(text.strip('"')[0]) and b >= len(text) - 1
    assert found("40% of it, 50%25 of that and \\u0041 word") == ([], 0)


def test_wrapped_base64():
    r = random.Random(2)
    lead = "".join(r.choice("abc def ") for _ in range(50))
    for data in (f"{lead} {SECRET} {lead}".encode(), gzip.compress(f"{r.random()} {lead} {SECRET}".encode())):
        for width in (20, 64):
            plain = base64.b64encode(data).decode()
            block = "\n".join(plain[k : k + width] for k in range(0, len(plain), width))
            text = f"see\n{block}\nThe end"
            spans, _ = found(text)
            assert any(k == 0 and a >= 4 and b <= 4 + len(block) for a, k, b in spans), (width, text)


def test_compressed_to_its_end(monkeypatch):
    filler = ("lines of text é\n" * 200_000).encode()
    stretch = base64.b64encode(gzip.compress(filler * 6 + SECRET.encode())).decode()
    assert found(f"a {stretch} b") == ([(2, 0, 2 + len(stretch))], 0)
    joined = base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode())).decode()
    assert found(joined) == ([(0, 0, len(joined))], 0)
    monkeypatch.setattr(secrets, "CHUNK", 1000)
    for shift in range(0, 40, 3):
        small = base64.b64encode(gzip.compress(b"x " * 480 + b" " * shift + SECRET.encode() + b" y" * 700)).decode()
        assert found(small) == ([(0, 0, len(small))], 0)
    broken = base64.b64encode(gzip.compress(SECRET.encode())[:-6]).decode()
    assert found(broken)[1] == 1


def test_base_spans_of_all_documents(spark, small):
    """The query's base columns against plain regular expressions, text by text."""
    import hashlib

    import duckdb

    texts = dict(duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())
    rows = secrets.op6_secrets(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        told = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in found) for n in range(3)]
        assert set(told) <= set(r["spans"].split(",")) or not told


def test_every_way_of_packing():
    """Each way to compress, over base64 and hexadecimal, alone, in lines, and at two places."""
    import base64
    import bz2
    import gzip
    import lzma
    import zlib

    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    plain = b"some notes before password=hunter2hunter2 and some after it\n" * 3
    ways = [plain, gzip.compress(plain), zlib.compress(plain), bz2.compress(plain), lzma.compress(plain), raw.compress(plain) + raw.flush()]
    for data in ways:
        for written in (base64.b64encode(data).decode(), data.hex(), base64.encodebytes(data).decode().strip(), base64.b64encode(data.hex().encode()).decode()):
            text = f"one {written} two {written} end"
            base, every = secrets.all_spans(text)
            added = [x for x in every if x not in base and x[1] == 0]
            for at in (4, 4 + len(written) + 5):
                assert any(at <= s < e <= at + len(written) for s, _, e in added), (data[:4], written[:20], at)


def test_what_stands_in_front():
    """Paths, names, stray letters and 0x before encoded and compressed stretches shift them, but hide nothing; spans lie on the stretch."""
    import bz2
    import lzma
    import zlib

    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    plain = f"some notes before {SECRET} and after".encode()
    ways = [plain, gzip.compress(plain), zlib.compress(plain), bz2.compress(plain), lzma.compress(plain), raw.compress(plain) + raw.flush()]
    for data in ways:
        for lead in ("", "x/", "key-", "id_", "data-", "https://h.example/", "https://h/a/", "q", "ab", "abc", "a1/b2/"):
            written = base64.b64encode(data).decode()
            text = f"see {lead}{written} end"
            at = text.index(written)
            assert any(k == 0 and at <= a and b <= at + len(written) for a, k, b in found(text)[0]), (data[:4], lead)
        for lead in ("0x", "a", "F", "id_a", "", "/0x"):
            for written in (data.hex(), data.hex().upper()):
                text = f"see {lead}{written} end"
                at = text.index(written)
                assert any(k == 0 and at <= a and b <= at + len(written) for a, k, b in found(text)[0]), (data[:4], lead)
    for text in ("plain/words/of-a-path_that/hides-nothing/at_all/in-it", "ordinaryletterswithoutanyend" * 40, "0x" + "00" * 400):
        assert [x for x in found(text)[0] if x[1] != 2] == [] and found(text)[1] == 0


def test_bytes_that_are_not_text():
    """Latin-1, and archives with runs of zeros, are scanned as they are."""
    for data in (f"clé {SECRET} été".encode("latin-1"), b"\x00" * 5000 + SECRET.encode() + b"\x00" * 5000):
        stretch = base64.b64encode(gzip.compress(data)).decode()
        assert found(f"a {stretch} b") == ([(2, 0, 2 + len(stretch))], 0)


def test_added_spans_by_brute_force():
    """Random texts of plain and encoded secrets: an added span for each encoded one, on its stretch, and none anywhere else."""
    r = random.Random(12)
    words = "the sea was calm and ship went on along its shore until dusk".split()
    encoders = [
        lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="), lambda s: s.encode().hex(), lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(s.encode().hex().encode()).decode(),
    ]
    for _ in range(150):
        text, want = "", []
        for _ in range(r.randrange(1, 8)):
            text += " ".join(r.choices(words, k=r.randrange(1, 9))) + " "
            if r.random() < 0.7:
                secret = f"{r.choice(('password', 'api_key', 'token'))}={''.join(r.choices('ghjkmnpqrstuvwyz', k=r.randrange(8, 20)))}"
                hidden = f"{r.choice(('note ', ''))}{secret} ok"
                made = r.choice(encoders)(hidden)
                want.append((len(text), len(text) + len(made)))
                # a line break alone would make the next word a line of the same block
                text += made + r.choice((" ", ", ", ".\n"))
        added = [x for x in found(text)[0] if x[1] == 0]
        assert all(any(a <= s and e <= b for s, _, e in added) for a, b in want), text
        assert all(any(a <= s and e <= b for a, b in want) for s, _, e in added), text
