import json
import random

import pytest

from chatloom.operators import calls as K
from chatloom.plans.calls import only_allowed

LS = [{"name": "bash", "arguments": {"command": "ls"}}]


def native(body):
    return f"{K.OPEN}{body}{K.CLOSE}"


@pytest.mark.parametrize("text", [
    native("[bash(command='ls')]"), native("bash(command=\"ls\")"), '{"name": "bash", "arguments": {"command": "ls"}}', '[{"function": {"name": "bash", "arguments": "{\\"command\\": \\"ls\\"}"}}]', '{"tool_calls": [{"tool": "bash", "args": {"command": "ls"}}]}',
    'x <TOOL_CALL>{"tool_name": "bash", "parameters": {"command": "ls"}}</TOOL_CALL> y', '```json\n{"name": "bash", "arguments": {"command": "ls"}}\n```', "bash(command='ls')", "[bash('ignored', command='l' 's')]",
])
def test_equal_encodings_of_one_call(text):
    assert K.parse_any(text)[1] == LS


@pytest.mark.parametrize("text", [None, "", 'so {"name": "bash"} it is', "bash", "a.b", "[1, 2]", "f(x=1) and more", native("[bash(command='ls']"), native("[f(x=1 + 2)]"), native("f(x=g(y=1))"), native("f(x={[1]: 2})"), "{}", "[]", "(" * 5000, "[" * 5000 + "]" * 5000, "f(" * 5000, "\ud800", "'" * 9999])
def test_what_is_no_call(text):
    content, calls = K.parse_any(text)
    assert calls == [] and content == K.cleaned(text)
    K.spans(text)


def test_native_blocks():
    body = "[f(x=-1, y=true, z=True, w=None, l=(1, 2.5), m='q', d={1: [-2]}), 5, a.b(u=word)]"
    text = f"<think>f(x=1)</think> a {native(body)} b {native('g(x=1)')}<|im_end|>"
    content, calls = K.parse(text)
    assert calls == [{"name": "f", "arguments": {"x": -1, "y": "true", "z": True, "w": None, "l": [1, 2.5], "m": "q", "d": {1: [-2]}}}, {"name": "a.b", "arguments": {"u": "word"}}]
    assert content == f"a  b {native('g(x=1)')}"
    assert K.parse(native("[f(a='x\\n\\x41\\u00e9\\'', b=r'\\n', c=\"\"\"t\"\"\")]"))[1][0]["arguments"] == {"a": "x\nAé'", "b": "\\n", "c": "t"}


def test_reading_gives_back_what_was_rendered():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(8 if depth < 3 else 5)
        if kind < 2:
            return "".join(rng.choice("ab'\"\\\n\té{}[](),= ") for _ in range(rng.randrange(12)))
        if kind < 6:
            return [rng.randrange(-9, 9), rng.random(), rng.random() < 0.5, None][kind - 2]
        return [value(depth + 1) for _ in range(rng.randrange(3))] if kind == 6 else {f"k{k}": value(depth + 1) for k in range(rng.randrange(3))}

    for _ in range(300):
        calls = [{"name": "do.it" if rng.random() < 0.2 else "do", "arguments": {f"a{k}": value(0) for k in range(rng.randrange(4))}} for _ in range(rng.randrange(1, 3))]
        text = K.render(json.dumps(calls), "so ")
        assert K.parse(text) == ("so", calls)


def test_rendering():
    assert K.render('[{"function": {"name": "exec_command", "arguments": "{\\"cmd\\": \\"pytest -q\\"}"}}]', "p") == "p" + native("[bash(command='pytest -q')]")
    assert K.render('[{"name": "lsp", "arguments": {"file_path": "a", "line": 3}}, {}, 7]', "") == native("[lsp(filePath='a', line=3)]")
    assert K.render('[{"name": "f", "arguments": "oops"}]', None) == native("[f(raw='oops')]") and K.render('[{"name": "f", "arguments": [1]}]', "") == native("[f(value=[1])]")
    assert K.render("[{}]", "p") == "p" and K.render("no json", "p") == "p" and K.render(None, None) is None
    assert K.literal_reference("{'name': 'shell', 'arguments': {'cmd': 'ls'}}") == native("[bash(command='ls')]") and K.literal_reference("plain") == "plain" and K.literal_reference(None) is None


@pytest.mark.parametrize(("key", "got", "want", "same"), [
    ("t", '"30"', "30", True), ("t", '" +30 "', "30", True), ("t", '"30.0"', "30", False), ("t", '"3.5"', "3.5", True), ("t", "3", "3.0", True), ("t", '"x"', "3.5", False), ("b", '"TRUE"', "true", True), ("b", '"yes"', "true", False), ("path", '"a//b/./c"', '"a/b/c"', True),
    ("other", '"a//b"', '"a/b"', False), ("command", "\"ls 'x'\"", '"ls x"', True), ("command", "\"ls 'x\"", '"ls x"', False), ("content", '"a\\r\\n\\n"', '"a"', True), ("q", '"a "', '"a"', False), ("l", '["1", 2]', "[1, 2]", True), ("l", "[1]", "[1, 2]", False),
    ("d", '{"a": "1", "path": "./x"}', '{"a": 1, "path": "x"}', True), ("d", '{"a": 1}', '{"a": 1, "b": 2}', False), ("n", "null", "null", True), ("n", "1", "null", False), ("n", None, "1", None), ("n", "1", "{", None), ("n", "[" * 9000, "1", None),
])
def test_elastic(key, got, want, same):
    assert K.same(key, got, want) is same


def shown(text, without=1):
    return [(text[s["start"] : s["stop"]], s["role"]) for s in K.spans(text) if s["role"] != without]


def test_members_that_are_no_calls_are_passed_over():
    named = lambda body: [(c["name"], c["arguments"]) for c in K.parse(native(body))[1]]
    assert named("[f(**{'a': 1}), g(y=2)]") == [("f", {}), ("g", {"y": 2})] and named("[f(x=0b11)]") == [("f", {"x": 3})]
    assert named("[a + b, f(x=1)]") == named("[f(1 + 2, x[0], *y, x=1)]") == named("[lambda: 1, [g(z=1)], f(x=1)]") == [("f", {"x": 1})]
    for body in ("[f(x=1+2), g(y=1)]", "[f()(x=1)]", "[f(x=b'1')]", "[f(x={**a})]", "[f(x=not y)]", "[f(x=-'a')]", f"[f(x={'9' * 5000})]", f"[f(x=0x{'f' * 5000})]", "[f(x=1j)]", "[f(x=...)]"):
        assert K.parse(native(body)) == (native(body), [])
    assert K.structs([{"name": "f", "arguments": {"d": {1: 2, "a": None, None: 3}, "s": "\ud800x"}}]) == [{"name": "f", "arguments": '{"d": {"1": 2, "a": null, "null": 3}, "s": "\\ud800x"}'.replace("\\ud800", "")}]


def test_spans_of_native_blocks():
    text = "é<|tool_call_start|>[bash(command='ü', n=1)]<|tool_call_end|><|im_end|>"
    assert shown(text) == [("bash", 2), ("command", 3), ("'ü'", 4), ("n", 3), ("1", 4), (K.CLOSE, 5), ("<|im_end|>", 5)]
    assert [x for x, role in shown(text, 0) if role == 1] == [K.OPEN, "[", "(", "=", ",", "=", ")", "]"]
    text = native("[f(x=g(y=1), z='a, b(c=2)', w={'k': [1, 2]} ), a.b(q = 3 )]") + native("oops(x='open, y=2")
    assert shown(text) == [("f", 2), ("x", 3), ("g(y=1)", 4), ("y", 3), ("1", 4), ("z", 3), ("'a, b(c=2)'", 4), ("w", 3), ("{'k': [1, 2]}", 4), ("q", 3), ("3", 4), (K.CLOSE, 5), ("x", 3), ("'open, y=2", 4), (K.CLOSE, 5)]
    assert [x for x, _ in shown("so " + K.OPEN + "[f(x=1", 0)] == [K.OPEN]


@pytest.mark.parametrize(("text", "want"), [
    ("x = load(p='a')\nuse(x)", [("x", 4), ("load", 2), ("p", 3), ("'a'", 4), ("use", 2), ("x", 4)]), ("x = f(\n a=1,\n b=2)", [("x", 4), ("f", 2), ("a", 3), ("1", 4), ("b", 3), ("2", 4)]), ("if ok:\n    f(a=1)", [("f", 2), ("a", 3), ("1", 4)]),
    ("import os\nx = f(a=1)", [("x", 4), ("f", 2), ("a", 3), ("1", 4)]), ("x = f(a=1)[0]", [("f", 2), ("a", 3), ("1", 4)]), ("y = a.b(c=1).d(e=2)", [("y", 4), ("a.b", 2), ("a.b(c=1).d", 2), ("c", 3), ("1", 4), ("e", 3), ("2", 4)]),
    ("x: int = f(a=1 + 2)", [("x", 4), ("f", 2), ("a", 3), ("1 + 2", 4)]), ("a, b = c = f(*z, **{'k': g()})", [("a, b", 4), ("c", 4), ("f", 2), ("*z", 4), ("{'k': g()}", 4), ("g", 2)]),
    ("é = 'ü🙂'; ö = f('é', kü=[1])\r\n#ß\rx = g('ß')", [("ö", 4), ("f", 2), ("'é'", 4), ("kü", 3), ("[1]", 4), ("x", 4), ("g", 2), ("'ß'", 4)]),
])
def test_spans_of_code(text, want):
    assert shown(text) == want and shown(text + "<|im_end|>")[-1] == ("<|im_end|>", 5)
    marks = "".join(x for x, role in shown(text, 0) if role == 1)
    assert marks.replace("'", "") == "".join(c for c in text if c in "=(),[]{}:.")


@pytest.mark.parametrize("text", [None, "", "just prose here", "x = 3", "f(a=1", "def f(:", "x = f(a='b)", "(" * 9000, "f(" * 5000 + ")" * 5000, "-" * 90000 + "f(1)", "f(x)\x00", "  f(x)\n y"])
def test_texts_without_spans(text):
    assert K.spans(text) == []


def test_legacy_scores():
    score = K.legacy_score
    assert score([["integral(x=5, y=1, function='x**3')"]], None, "BFCL_v4_irrelevance") == (False, False)
    assert score([["The integral is 156."]], None, "BFCL_v4_irrelevance", False) == (True, True) and score("ok", None, "simple") == (False, False)
    assert score(["Error: request timed out"], None, "BFCL_v4_irrelevance") == (False, False)
    assert score([["find(a=1)"], ["no"]], {"ground_truth": [["x.find(a=2)"], ["stop()"]]}, "multi") == (False, True) and score([["find(a=1)"], ["x"]], {"ground_truth": [["find(a=2)"], []]}, "multi") == (True, True)
    assert score("find(lang=5)", {"ground_truth": [{"a.find": {"lang": [5, ""]}}]}, "simple") == (True, True) and score("find(lang=6)", {"ground_truth": [{"a.find": {"lang": [5, ""]}}]}, "simple") == (False, True)
    assert score("x", {"ground_truth": []}, "simple") == (True, True) and score("go en", {"possible_answers": ["x.go(1)"]}, "simple") == (False, True)


def test_no_row_with_allowed_tools_only_is_an_error(spark):
    rows = spark.createDataFrame([(native("[rm(x=1)]"),)], "t string")
    with pytest.raises(ValueError, match="allowed"):
        only_allowed(rows, "t", ["read"])
    assert only_allowed(rows, "t", ["rm"]).count() == 1
