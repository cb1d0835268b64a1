"""Derivations, shrinking and findings."""

import json

from quillon.operators import grammars as g
from quillon.plans.grammar_queries import PLAIN, TOY


def test_grammar():
    toy = g.Grammar(TOY)
    assert toy.start == "program" and len(toy.sites) == 5 and toy.shortest["program"] == 2
    assert toy.reaching({"binary"}) == {"binary", "_expression", "if_statement", "call", "_statement", "block", "program"}
    endless = g.Grammar(json.dumps({"rules": {"a": {"type": "SEQ", "members": [{"type": "STRING", "value": "x"}, {"type": "SYMBOL", "name": "a"}]}}}))
    assert endless.shortest["a"] == g.ENDLESS


def test_shorter_tapes_give_simpler_programs():
    toy = g.Grammar(TOY)
    assert g.Derivation(toy, b"").text == "( )\n"
    tape = bytes(range(1, 60))
    full = g.Derivation(toy, tape)
    assert g.Derivation(toy, bytes(full.record)).text.split()[:3] == full.text.split()[:3]
    assert full.taken and all(a < toy.sites[s][1] for s, a in full.taken)


def test_seeking_tapes_replay():
    toy, seen = g.Grammar(TOY), set()
    drawn = g.draws(3)
    for _ in range(30):
        made = g.Derivation(toy, g.random_tape(drawn, 256), seen)
        again = g.Derivation(toy, bytes(made.record))
        assert again.text == made.text and again.taken == made.taken
        seen |= set(made.taken)
    assert len(seen) == sum(n for _, n in toy.sites)


def test_layout_and_patterns():
    rules = {"p": {"type": "SEQ", "members": [{"type": "STRING", "value": "if"}, {"type": "SYMBOL", "name": "_nl"}, {"type": "SYMBOL", "name": "_in"}, {"type": "PATTERN", "value": "[^x]\\d+"}, {"type": "SYMBOL", "name": "_nl"}, {"type": "SYMBOL", "name": "_out"}, {"type": "SYMBOL", "name": "word"}]}}
    made = g.Derivation(g.Grammar(json.dumps({"rules": rules}), {"_nl": "NEWLINE", "_in": "INDENT", "_out": "DEDENT"}), b"")
    assert made.text == "if\n    a1\na\n"
    assert [g.first_alternative(x) for x in ("[a-z]\\w*", "\\s", "ab|c", "(x)+y?", ".", "")] == ["aa", "a", "ab", "xy", "a", "a"]


def test_tapes_change_and_shrink():
    drawn = g.draws(1)
    assert all(g.mutated(b"abc", drawn) for _ in range(50)) and len(g.mutated(b"", drawn)) == 64
    alive = lambda tapes: [b"\x07" in t for t in tapes]
    assert g.shrunk(bytes([1, 2, 7, 3, 9, 7, 4]), alive) == b"\x07"
    assert g.shrunk(b"", alive) == b""


def test_metrics_of_no_grammar(spark):
    assert g.metrics(spark.createDataFrame([], "grammar string, json string")).count() == 0
    assert g.metrics(spark.createDataFrame([("p", PLAIN)], "grammar string, json string").where("grammar = 'p'")).where("value > 0").count() == 1
