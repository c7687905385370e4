"""Rules of source extraction as a table: which entity a syntactic form gives, by language and by what it lies in.

The scanners of `extract` find forms; the row for (form, inside) says what becomes
of one.  A form without a row gives no entity, so JavaScript needs no case of its
own where TypeScript has more.  Names and scopes are templates over the facts that a
scanner passes; an empty one means the name as written, in the scope it lies in.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    form: str
    inside: str = ""  # words; empty: anywhere that no other row names
    kind: str = ""
    name: str = ""
    scope: str = ""
    visibility: str = "written"  # or a fixed one; "none" for no visibility
    flags: str = ""  # flags that the entity carries
    details: str = ""  # texts that it carries
    relations: str = ""  # relation fields, always present


FUNCTION = "is_async is_const is_unsafe is_generic"
MEMBERS = "is_static is_abstract is_async is_readonly is_optional is_getter is_setter is_generator is_generic"
BODY = "calls uses_types"

RUST = (
    Rule("E-MOD-CRATE", "file", "", "Module", visibility="Public", relations="imports reexports"),
    Rule("E-MOD-DECL", "mod", "", "Module", relations="imports reexports"),
    Rule("E-FN-FREE", "fn", "", "Function", flags=FUNCTION, relations=BODY),
    Rule("E-METHOD-SELF", "method", "impl", "Method", flags=FUNCTION, relations=BODY),
    Rule("E-METHOD-RETURNS-SELF", "builder", "impl", "Method", flags=FUNCTION, relations=BODY),
    Rule("E-FN-ASSOC", "fn", "impl", "Function", flags=FUNCTION, relations=BODY),
    Rule("E-METHOD-TRAIT-IMPL", "method builder fn", "trait-impl", "Method", visibility="Public", flags=FUNCTION, relations=BODY),
    Rule("E-METHOD-TRAIT-DEF", "method builder fn", "trait", "Method", visibility="none", flags=FUNCTION, relations=BODY),
    Rule("E-STRUCT", "struct", "", "Struct", flags="is_generic is_tuple_struct is_unit_struct", relations="uses_types"),
    Rule("E-PROPERTY", "field", "", "Property", details="type", relations="uses_types"),
    Rule("E-ENUM", "enum", "", "Enum", flags="is_generic", relations="uses_types"),
    Rule("E-ENUM-VARIANT", "variant", "", "EnumVariant", visibility="Public"),
    Rule("E-UNION", "union", "", "Union", flags="is_generic", relations="uses_types"),
    Rule("E-TRAIT", "trait", "", "Trait", flags="is_generic", relations="extended_types"),
    Rule("E-TYPE-ALIAS", "type", "", "TypeAlias", flags="is_generic", relations="uses_types"),
    Rule("E-TYPE-ALIAS-ASSOC", "type", "trait-impl", "TypeAlias", visibility="Public", flags="is_generic", relations="uses_types"),
    Rule("E-IMPL-INHERENT", "impl", "", "Impl", name="<{of}>", visibility="Public", relations="for_type implements"),
    Rule("E-IMPL-TRAIT", "trait-impl", "", "Impl", name="<{of} as {trait}>", visibility="Public", relations="for_type implements"),
    Rule("E-CONST", "const", "", "Constant", flags="is_const", details="type", relations="uses_types"),
    Rule("E-CONST-ASSOC", "const", "impl", "Constant", flags="is_const", details="type", relations="uses_types"),
    Rule("E-CONST-ASSOC", "const", "trait-impl", "Constant", visibility="Public", flags="is_const", details="type", relations="uses_types"),
    Rule("E-STATIC", "static", "", "Static", flags="is_mutable", details="type", relations="uses_types"),
    Rule("E-EXTERN-BLOCK", "extern", "", "ExternBlock", name='extern "{abi}"', visibility="none"),
    Rule("E-EXTERN-FN", "fn", "extern", "Function", scope='{scope}::extern "{abi}"', flags=FUNCTION, relations="uses_types"),
    Rule("E-EXTERN-STATIC", "static", "extern", "Static", scope='{scope}::extern "{abi}"', flags="is_mutable", details="type", relations="uses_types"),
    Rule("E-MACRO-RULES", "macro_rules!", "", "Macro"),
)

JAVASCRIPT = (
    Rule("E-MOD-FILE", "file", "", "Module", visibility="Public", relations="imports reexports"),
    Rule("E-FN-DECL", "function", "", "Function", flags="is_async is_generator is_generic", relations="calls"),
    Rule("E-FN-EXPR", "function-value", "", "Function", flags="is_async is_generator", relations="calls"),
    Rule("E-FN-ARROW", "arrow", "", "Function", flags="is_async is_arrow", relations="calls"),
    Rule("E-CONST", "const", "", "Constant", flags="is_const", details="type"),
    Rule("E-VAR-LET", "let", "", "Variable"),
    Rule("E-VAR-VAR", "var", "", "Variable"),
    Rule("E-CLASS", "class", "", "Class", flags="is_abstract is_generic", relations="extends implements"),
    Rule("E-CLASS-EXPR", "class-value", "", "Class", flags="is_abstract is_generic", relations="extends implements"),
    Rule("E-METHOD-CLASS", "method", "class", "Method", flags=MEMBERS, relations="calls"),
    Rule("E-PROPERTY-FIELD", "field", "class", "Property", flags=MEMBERS, details="type", relations="calls"),
)

#: TypeScript has every row of JavaScript, with the types that it names, and these.
TYPESCRIPT = (
    *(rule._replace(relations=rule.relations.replace("calls", BODY) or ("" if rule.form == "file" else "uses_types")) if rule.form not in ("file", "class", "class-value") else rule for rule in JAVASCRIPT),
    Rule("E-INTERFACE", "interface", "", "Interface", flags="is_generic", relations="extended_types uses_types"),
    Rule("E-INTERFACE-PROPERTY", "field", "interface", "Property", visibility="Public", flags=MEMBERS, details="type", relations="uses_types"),
    Rule("E-INTERFACE-METHOD", "method", "interface", "Method", visibility="Public", flags=MEMBERS, relations="uses_types"),
    Rule("E-INTERFACE-CALL-SIG", "call", "interface", "Method", name="()", visibility="Public", relations="uses_types"),
    Rule("E-INTERFACE-CONSTRUCT-SIG", "construct", "interface", "Method", name="new()", visibility="Public", relations="uses_types"),
    Rule("E-INTERFACE-INDEX-SIG", "index", "interface", "Property", name="[{key}]", visibility="Public", details="type", relations="uses_types"),
    Rule("E-TYPE-ALIAS", "type", "", "TypeAlias", flags="is_generic", relations="uses_types"),
    Rule("E-ENUM", "enum", "", "Enum", flags="is_const"),
    Rule("E-ENUM-MEMBER", "variant", "", "EnumVariant", visibility="Public"),
    Rule("E-MOD-NAMESPACE", "namespace", "", "Module"),
    Rule("E-METHOD-ABSTRACT", "abstract-method", "class", "Method", visibility="Public", flags=MEMBERS, relations="uses_types"),
    Rule("E-AMBIENT-FN", "function", "ambient", "Function", visibility="Public", flags="is_generic", relations="uses_types"),
    Rule("E-AMBIENT-CONST", "const", "ambient", "Constant", visibility="Public", flags="is_const", details="type", relations="uses_types"),
    Rule("E-AMBIENT-LET", "let", "ambient", "Variable", visibility="Public", relations="uses_types"),
    Rule("E-AMBIENT-VAR", "var", "ambient", "Variable", visibility="Public", relations="uses_types"),
    Rule("E-AMBIENT-CLASS", "class", "ambient", "Class", visibility="Public", flags="is_abstract is_generic", relations="extends implements"),
    Rule("E-PARAM-PROPERTY", "parameter", "class", "Property", flags="is_readonly is_optional", details="type", relations="uses_types"),
)


def by_form(rules: tuple[Rule, ...]) -> dict[tuple[str, str], Rule]:
    return {(form, inside): rule for rule in rules for form in rule.form.split() for inside in (rule.inside.split() or [""])}


RULES = {"Rust": by_form(RUST), "JavaScript": by_form(JAVASCRIPT), "TypeScript": by_form(TYPESCRIPT)}
