import pytest

from veilspan import catalog as C


def test_taxonomy_and_labels():
    assert {r.kind for r in C.RULES} <= set(C.TAXONOMY)
    assert len(C.BIOES_LABELS) == 33 and C.BIOES_LABELS[1] == "B-account_number" and C.BIOES_LABELS[-1] == "S-secret"


def test_rule_list():
    rules = C.save_rule([], "A", "regex", r" x\d ", 5)
    assert rules[0].id == "rule-5-0" and rules[0].pattern == r"x\d"
    with pytest.raises(C.DuplicateRule):
        C.save_rule(rules, "B", "regex", r"x\d")
    with pytest.raises(C.InvalidRule):
        C.save_rule(rules, "B", "regex", "[a(")
    with pytest.raises(C.InvalidRule):
        C.save_rule(rules, "B", "exact", "  ")
    assert C.find_duplicate(rules, "regex", r"x\d", "rule-5-0") is None
    assert C.update_rule(rules, "rule-5-0", name="Z", id="no")[0] == C.UserRule("rule-5-0", "Z", "regex", r"x\d")
    assert C.update_rule(rules, "unknown", name="Z") == rules
    assert C.remove_rule(rules, "rule-5-0") == []
    assert C.UserRule("a", "  ", "exact", "x").kind == "Custom"


def test_blanks_are_spelled_out():
    assert C.blanks(r"a\sb[\s-]\S[\s\S]", body="_") == r"a[_]b[_-][^_][\s\S]"
