import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import urllib.parse
import zlib

import zstandard

from brooktext.llm.secrets import _Unescaped, joined, scan, scan_secrets

SECRET = "password=abcdefghijklmnop1"


def brute_base(t):
    """The base spans by the patterns as they are stated, in plain Python."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, m.end(), "assign")] if len(m[2]) >= 12 else []
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_like_brute_force(docs):
    for r in docs.collect():
        assert scan(r.text)[0] == brute_base(r.text)
    for t in ("token: secret: abcdefghijklmnop", "API_KEY = 'aaaaaaaaaaaa'", "AKIAAKIA" + "A" * 12, "secret=short secret=longenough123", "tokentoken=0123456789abcdef", "password=" + "f" * 12, "é password: \"abcdefghijkl\""):
        assert scan(t)[0] == brute_base(t), t


def layers(t):
    return [(t[s:e], k) for s, e, k in scan(t)[1]]


def test_layers():
    quoted = urllib.parse.quote(SECRET, safe="").replace("p", "%70")
    packed = base64.b64encode(SECRET.encode()).decode()
    assert layers(f"x {quoted} y") == [(quoted, "url>assign")]
    assert layers("a " + SECRET.replace("p", "\\u0070", 1) + " b") == [(SECRET.replace("p", "\\u0070", 1), "unicode>assign")]
    assert layers(f"é {packed} y") == [(packed, "base64>assign")]
    for pack in (gzip.compress, bz2.compress):
        inner = base64.b64encode(pack(quoted.encode())).decode()
        assert layers(f"see {inner}.") == [(inner, "base64>compressed>url>assign")]
    twice = base64.b64encode(packed.encode()).decode()
    assert layers(twice) == [(twice, "base64>base64>assign")]


def test_packed_layers():
    """Wrapped, misaligned, 16-bit and percent-encoded layers, and layers within layers, each against the place they were put in."""
    plain = b"first line\n" * 20 + SECRET.encode()
    wrapped = base64.encodebytes(gzip.compress(random.Random(5).randbytes(300) + plain)).decode().strip()
    assert wrapped.count("\n") > 2 and layers(f"x\n{wrapped}\n\nend") == [(wrapped, "base64>compressed>assign")]
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress, zstandard.compress, bytes):
        run = base64.b64encode(pack(plain)).decode().rstrip("=")
        for head in ("blob/", "x-", "ab/", "abcd/"):
            assert [s for s, _ in layers(f"see {head}{run}.")] == [head + run], (pack, head)
    for coding in ("utf-16", "utf-16-le", "utf-16-be"):
        run = base64.b64encode(SECRET.encode(coding)).decode()
        assert layers(f"see {run}") == [(run, "base64>assign")], coding
    run = urllib.parse.quote(gzip.compress(plain), safe="")
    assert layers(f"see {run} end") == [(run, "url>compressed>assign")]


def nest(t, rng, depth):
    for _ in range(depth):
        sort = rng.randrange(4)
        if sort == 0:
            t = "".join(f"%{ord(c):02X}" if rng.random() < 0.3 or c in "%=\\&" else c for c in t)
        elif sort == 1:
            t = "".join(f"\\u{ord(c):04x}" if rng.random() < 0.3 or c in "\\=" else c for c in t)
        elif sort == 2:
            t = base64.b64encode(t.encode()).decode()
        else:
            t = base64.b64encode(rng.choice([gzip.compress, bz2.compress])(t.encode())).decode()
    return t


def test_random_nests_are_found_at_their_place():
    rng = random.Random(11)
    for _ in range(300):
        t = nest(SECRET, rng, rng.randrange(1, 7))
        if not re.search(r"[%\\]", t) and brute_base(t):
            continue
        got = scan(f"é see {t} end")[1]
        assert any(k.endswith("assign") and 6 <= s <= e <= 6 + len(t) for s, e, k in got), t


def step(t):
    """One escape decoded, the first, in plain Python; None when there is none."""
    m = re.search(r"%([0-7][0-9A-Fa-f])|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});", t)
    code = m and int(next(filter(None, m.groups())), 16)
    return m and t[: m.start()] + (chr(code) if code < 0x110000 else "?") + t[m.end() :]


def test_escapes_to_their_fixpoint_like_step_by_step():
    rng = random.Random(3)
    for _ in range(3000):
        t = want = "".join(rng.choice(["%", "25", "4", "1", "\\u00", "\\x", "&#x0", "3", "2", ";", "z", "5"]) for _ in range(rng.randrange(1, 16)))
        while (new := step(want)) is not None:
            want = new
        if not re.search(r"%[89A-Fa-f][0-9A-Fa-f]", want):  # bytes that are no characters of their own
            assert _Unescaped(t).text == want, t


def test_long_nests_take_time_in_proportion():
    start = time.monotonic()
    for t in ("%" + "25" * 200_000, "%" * 100_000 + "33" * 100_000, "%5C" + "u0025" * 100_000, "A" * 1_000_000, "\\u005cu0025" * 50_000):
        scan(t)
    assert time.monotonic() - start < 60
    assert layers("%" + "25" * 100_000 + "70assword=abcdefghijklmnop1")[-1][1] == "url>assign"


def test_every_place_of_a_repeated_layer():
    packed = base64.b64encode(SECRET.encode()).decode()
    twice = base64.b64encode(packed.encode()).decode()
    t = f"a {packed} b {packed}\nc {twice} d {packed} %41 {twice}"
    at = [(m.start(), m.end(), f"{k}assign") for x, k in ((packed, "base64>"), (twice, "base64>base64>")) for m in re.finditer(re.escape(x), t)]
    assert len(at) == 5 and scan(t)[1] == sorted(at)


def test_it_ends_and_keeps_base_spans():
    assert layers("%2525252525" * 50) == []
    t = SECRET + " %41"
    assert scan(t)[0] == brute_base(t) and scan(t)[1] == []
    packed = base64.b64encode(gzip.compress(b"password=abcdefghijklmnop1 " * 100_000)).decode()
    assert scan(packed, 1 << 20)[1:] == ([], 1) and scan(packed)[1:] == ([(0, len(packed), "base64>compressed>assign")], 0)


def test_table(odd, empty, docs):
    assert scan_secrets(empty).count() == 0
    got = scan_secrets(odd).collect()
    assert len(got) == odd.count() and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    want = {r.doc_id: brute_base(r.text) for r in docs.collect()}
    for r in scan_secrets(docs).collect():
        base = want[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for *_, k in base) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()


def test_readable_counts_like_a_look_at_each_character():
    from brooktext.llm.secrets import _readable

    rng = random.Random(6)
    for _ in range(400):
        data = "".join(rng.choice("ab \t\n\r\x00\x7f\x1fé中 ​😀" if rng.random() < 0.5 else "abc é") for _ in range(rng.randint(0, 60))).encode() + rng.choice([b"", b"\xff"])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = ""
        odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
        assert _readable(data) == (text if text and odd * 20 <= len(text) else None)
