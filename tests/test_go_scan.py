"""The scanner of Go files passes over strings and names in one step each."""

import time

from tessera.operators import chunking


def test_odd_strings_and_lines():
    text = b'package p\nvar a = "}\\"{" + `\\`\nfunc F() {\n\tx1+y("\n(")\n\tz = \'"\'\n\treturn\n}\n// {\n/* " */ type T struct {\n\ta.b, c\n}\nconst q = "open \\'
    top, inner = chunking.go_scan(text)
    assert [k for _, k in top] == ["package", "var", "func", "const"]
    assert [text[i : i + 1] for i, _ in inner] == [b"x", b"z", b"r", b"a"]


def test_a_long_string_takes_no_step_a_byte():
    text = b'package p\n\nvar a = "' + b"w" * 10_000_000 + b'"\nfunc F() {\n}\n'
    began = time.monotonic()
    assert [k for _, k in chunking.go_scan(text)[0]] == ["package", "var", "func"]
    assert time.monotonic() - began < 1.5
