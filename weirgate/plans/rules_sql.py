"""DuckDB SQL of the rule queries. Its regular expressions have no lookaround, so what stands before or after a match is read along with it and left out of the span."""

from __future__ import annotations

from weirgate.sources.rules import Rule, active_layer_1, active_scanner, seed_rules

#: (what a rule's pattern asks of the text before it, the rest of the pattern, what it asks of the text after it), where it does.
AROUND = {
    "RULE_PII_PHONE_01": (r"^|[^\w+]", r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,3}\b", ""),
    "RULE_PII_PHONE_02": (r"^|[^0-9]", r"(?:\+?1[ .\-]?)?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}", r"[^0-9]|$"),
    "RULE_PII_PHONE_03": (r"^|[^0-9]", r"0[79]\d{8}", r"[^0-9]|$"),
    "RULE_PII_CARD_01": (r"^|[^0-9]", r"(?:\d[ \-]?){12,18}\d", r"[^0-9]|$"),
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _parts(rule: Rule) -> tuple[str, str, str]:
    return AROUND.get(rule.rule_id) or ("", rule.pattern, "")


def _whole(rule: Rule, spans: bool = False) -> str:
    """The pattern in three groups. For spans it reads the text with a mark before each space, so that two matches may share one."""
    before, inside, after = _parts(rule)
    flags = "(?i)" if inside.startswith("(?i)") else ""
    inside = inside.removeprefix("(?i)")
    return f"{flags}({before})({inside.replace('[ ', '\x01?[ ') if spans and after else inside})({after})"


def _condition(rule: Rule) -> str:
    """SQL that holds where the normalised text t matches the rule."""
    if rule.rule_type == "KEYWORD":
        return f"contains(lower(t), {quoted(rule.pattern.lower())})"
    if rule.rule_id == "RULE_SYSTEM_OVERRIDE_01":  # unless it goes on about instructions somewhere else than in this conversation
        core, _, _ = rule.pattern.partition(r"\b(?!")
        tail = r"\b(?:\s+(?:in|of|about|regarding|concerning)\s+(?:this\s+(?:conversation|chat|session)\b)?)?"
        return f"len(list_filter(regexp_extract_all(t, {quoted(core + tail)}), lambda x: not regexp_matches(x, '(?i)\\s(?:in|of|about|regarding|concerning)\\s+$'))) > 0"
    if rule.rule_id == "RULE_JAILBREAK_01":  # a mode that is talked about is none
        about = r"(?:\b(?:on|about|of|regarding|called)\s)"
        dan = f"len(list_filter(regexp_extract_all(t, {quoted('(?i)' + about + '?' + chr(92) + 'bdan' + chr(92) + 's+mode' + chr(92) + 'b')}), lambda x: not regexp_matches(x, {quoted('(?i)^' + about)}))) > 0"
        return rf"(regexp_matches(t, '(?i)\bdo\s+anything\s+now\b|\bjailbroken\s+(mode|ai|version)\b') or {dan})"
    return f"regexp_matches(t, {quoted(_whole(rule))})"


def first_match_sql() -> str:
    rules = active_layer_1(seed_rules())
    cases = " ".join(f"when {_condition(r)} then {i + 1}" for i, r in enumerate(rules))
    names, kinds = (", ".join(quoted(getattr(r, c)) for r in rules) for c in ("rule_id", "category"))
    return rf"""
        with n as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{{a0}}]+', ' ', 'g')) t from documents),
        f as (select doc_id, case {cases} end i from n)
        select doc_id, [{names}][i] rule_id, [{kinds}][i] category from f where i is not null"""


def pii_scan_sql() -> str:
    found = " union all ".join(
        f"""select doc_id, {i} r, '{'SECRET_LEAK' if r.is_secret else 'PII_LEAK'}' category, {str(r.is_card).lower()} card, regexp_extract_all(t, {quoted(_whole(r, True))}, 0) whole,
            regexp_extract_all(t, {quoted(_whole(r, True))}, 1) pre, regexp_extract_all(t, {quoted(_whole(r, True))}, 2) core, regexp_split_to_array(t, {quoted(_whole(r, True))}) gaps
            from (select doc_id, {"replace(text, ' ', chr(1) || ' ')" if _parts(r)[2] else 'text'} t from documents) where regexp_matches(t, {quoted(_whole(r, True))})"""
        for i, r in enumerate(active_scanner(seed_rules()))
    )
    return f"""
        with m as ({found}),
        e as (select doc_id, r, category, card, whole, pre, core, gaps, unnest(range(1, len(whole) + 1)) i from m),
        o as (select doc_id, r, category, card, replace(core[i], chr(1), '') hit, coalesce(list_sum(list_transform(gaps[:i], lambda x: length(replace(x, chr(1), '')))), 0) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(replace(x, chr(1), '')))), 0) + length(replace(pre[i], chr(1), '')) s from e),
        d as (select o.*, s + length(hit) e, list_reverse(string_split(regexp_replace(hit, '[^0-9]', '', 'g'), '')) digits, text from o join documents using (doc_id)),
        k as (select * from d where e > s and not regexp_matches(substring(text, s::bigint, (case when s > 0 then 1 else 0 end)), '[0-9]') and not regexp_matches(substring(text, e::bigint + 1, 1), '[0-9]')
              and (not card or list_sum(list_transform(digits, lambda x, j: case when j % 2 = 1 then x::int else x::int * 2 - 9 * (x::int > 4)::int end)) % 10 = 0)),
        n as (select *, coalesce(s > max(e) over (partition by doc_id order by s, e, r rows between unbounded preceding and 1 preceding), true)::int new from k),
        g as (select *, sum(new) over (partition by doc_id order by s, e, r rows unbounded preceding) run from n),
        p as (select doc_id, run, min(s)::bigint s, max(e)::bigint e, arg_min(category, (s, e, r)) category, any_value(text) text from g group by 1, 2),
        l as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) last from p)
        select doc_id, '[' || string_agg('{{"start":' || s || ',"end":' || e || ',"category":"' || category || '"}}', ',' order by s) || ']' spans,
            string_agg(substring(text, last + 1, s - last) || '[REDACTED:' || category || ']', '' order by s) || substring(any_value(text), max(e) + 1) redacted from l group by doc_id"""
