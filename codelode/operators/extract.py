"""Source extraction: files to entity rows, by scanning text with comments and strings blanked out.

One scanner walks brace regions; each language gives the pattern of its items and
says how an item's region is read, and the rules of `extract_rules` say what entity
an item gives.  It reads Rust, JavaScript and TypeScript; it is a scanner, not a
full parser, so macros are not expanded and bodies are only searched for calls and
types, not for items of their own.  `extract_table` runs it over a table of files.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from codelode.operators.extract_rules import RULES, Rule

RUST_TOKEN = re.compile(r"//[^\n]*|/\*|\bb?r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}\n]*\}|[^xu\n])|[^'\\\n])'", re.S)
SCRIPT_TOKEN = re.compile(
    r"//[^\n]*|/\*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`|(?P<before>[(,=:\[!&|?{};]\s*|\breturn\s+)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*", re.S
)
COMMENT_EDGE = re.compile(r"/\*|\*/")
TEMPLATE_PART = re.compile(r"\\.|`|\$\{", re.S)
HOLE_PART = re.compile(r"[{}`]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
NAME = r"[A-Za-z_$][\w$]*"
CALL = re.compile(rf"(?<![\w$])((?:{NAME}(?:::<[^<>()]*>)?(?:::|\.))*)({NAME})\s*(?:::<[^<>()]*>)?\(")
TYPE_NAME = re.compile(r"\b([A-Z]\w*)\b")
# Words before a parenthesis that are no calls, and type names that are no references.
NO_CALLS = set("if for while match switch return fn function catch loop async move in as await typeof new super constructor impl where pub let const var else yield throw".split())
PRIMITIVES = set("Self String Vec Option Result Box Some None Ok Err Promise Array Record Map Set Date Error Partial Readonly".split())
EXTENSIONS = {"rs": "Rust", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript"}


@dataclass
class Entity:
    kind: str
    name: str
    qualified: str
    scope: str | None
    visibility: str | None
    start: int
    end: int
    doc: str | None = None
    rule: str = ""
    flags: dict = field(default_factory=dict)
    details: dict = field(default_factory=dict)
    refs: dict = field(default_factory=dict)
    aliases: list = field(default_factory=list)


def comment_end(source: str, at: int, nested: bool) -> int:
    """End of the block comment that begins at `at`; one that never ends takes the rest."""
    depth, at = 1, at + 2
    while depth and (m := COMMENT_EDGE.search(source, at)):
        depth += -1 if m[0] == "*/" else int(nested)
        at = m.end()
    return len(source) if depth else at


def template_end(source: str, at: int) -> int:
    """End of the template string whose text begins at `at`; its holes may hold strings and templates."""
    depths: list[int] = []  # open braces of each hole that is open; none: in the text of the outermost template
    in_text = True
    while m := (TEMPLATE_PART if in_text else HOLE_PART).search(source, at):
        at, found = m.end(), m[0]
        if in_text and found == "`":
            if not depths:
                return at
            in_text = False
        elif in_text and found == "${":
            depths.append(1)
            in_text = False
        elif not in_text and found == "`":
            in_text = True
        elif not in_text and found in "{}":
            depths[-1] += 1 if found == "{" else -1
            if not depths[-1]:
                depths.pop()
                in_text = True
    return len(source)


def blank(source: str, token: re.Pattern, nested: bool) -> str:
    """The source with comments, strings and patterns as spaces; places and line breaks stay."""
    parts, at = [], 0
    while m := token.search(source, at):
        start, end = m.start(), m.end()
        if m[0].startswith("/*"):
            end = comment_end(source, start, nested)
        elif m[0] == "`":
            end = template_end(source, end)
        elif not nested and m["before"]:
            start += len(m["before"])
        parts += [source[at:start], re.sub(r"[^\n]", " ", source[start:end])]
        at = end
    return "".join(parts) + source[at:]


class Scanner:
    sep = "."

    def __init__(self, source: str, module: str, package: str | None, language: str, with_refs: bool = True, with_doc: bool = True):
        self.source, self.module, self.package = source, module, package
        self.with_refs, self.with_doc = with_refs, with_doc
        self.rules = RULES[language]
        self.text = blank(source, RUST_TOKEN if self.sep == "::" else SCRIPT_TOKEN, self.sep == "::")
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}()\[\]]", self.text):
            if m[0] in "{([":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        self.found: list[Entity] = []
        self.imports: dict[str, str] = {}

    def body(self, at: int, end: int) -> tuple[int, int]:
        """(open brace or -1, end of the item) of an item whose head begins at `at`."""
        while at < end:
            c = self.text[at]
            if c == "{":
                return at, self.close.get(at, end) + 1
            if c == ";":
                return -1, at + 1
            at = self.close.get(at, at) + 1 if c in "([" else at + 1
        return -1, end

    def doc(self, at: int) -> str | None:
        """The unbroken run of documentation comments (and attributes) above a place."""
        line, out = self.source.rfind("\n", 0, at) + 1, []
        if self.source[line:at].strip():
            return None
        while line:
            stop = line - 1
            line = self.source.rfind("\n", 0, stop) + 1
            s = self.source[line:stop].strip()
            if m := re.match(r"(?:///|//!|/\*\*|\*/|\*)\s?(.*?)(?:\*/)?$", s):
                out.append(m[1])
            elif not s.startswith(("#[", "@")):
                break
        text = "\n".join(reversed(out)).strip()
        return text or None

    def calls(self, start: int, end: int) -> list[str]:
        out = []
        for m in CALL.finditer(self.text, start, end) if self.with_refs else ():
            path, name = re.sub(r"::<[^<>()]*>", "", m[1]), m[2]
            if name in NO_CALLS or re.search(r"\b(?:fn|function|new)\s+$", self.text[max(0, m.start() - 12) : m.start()]):
                continue
            before = self.before(m.start())
            if not path and before.endswith((".", "::")) and before != "..":  # of a value without a name
                out.append(name)
                continue
            found = self.call_target(path, name)
            out += found if isinstance(found, list) else [found]
        return list(dict.fromkeys(x for x in out if x))

    def before(self, at: int) -> str:
        """The two characters before a place, blanks left out."""
        while at and self.text[at - 1].isspace():
            at -= 1
        return self.text[max(0, at - 2) : at]

    def types(self, start: int, end: int) -> list[str]:
        if not self.with_refs:
            return []
        return list(dict.fromkeys(self.resolve(x) for x in TYPE_NAME.findall(self.text[start:end]) if x not in PRIMITIVES and len(x) > 1))

    def resolve(self, name: str) -> str:
        """Full name of a simple name: imported, else of this module."""
        return self.imports.get(name, self.sep.join(x for x in (self.module, name) if x))

    def rule(self, form: str, inside: str) -> Rule | None:
        return self.rules.get((form, inside)) or self.rules.get((form, ""))

    def add(self, form: str, inside: str, name: str, scope: str | None, written: str | None, start: int, end: int, facts=None, flags=None, details=None, refs=None, qualified=None) -> Entity | None:
        """The entity that the rule of the form gives, of what is told only what the rule asks for; None without a rule."""
        rule = self.rule(form, inside)
        if rule is None:
            return None
        facts = {"name": name, "scope": scope or "", **(facts or {})}
        name = rule.name.format(**facts) if rule.name else name
        qualified = qualified or self.sep.join(x for x in (scope, name) if x)
        scope = rule.scope.format(**facts).removeprefix(self.sep) if rule.scope else scope
        visibility = {"written": written, "none": None}.get(rule.visibility, rule.visibility)
        e = Entity(rule.kind, name, qualified, scope or None, visibility, start, end, self.doc(start) if self.with_doc else None, rule.id)
        e.flags = {k: bool((flags or {}).get(k)) for k in rule.flags.split()}
        e.details = {k: v for k in rule.details.split() if (v := re.sub(r"\s+", " ", (details or {}).get(k) or "").strip())}
        e.refs = {k: (refs or {}).get(k, []) for k in rule.relations.split()}
        self.found.append(e)
        return e


# Crates that are there without an import.
STANDARD = {"std", "core", "alloc"}
DECLARED = re.compile(r"\b(?:fn|struct|enum|union|trait|mod|type|const|static)\s+(?:mut\s+)?([A-Za-z_]\w*)")


class Rust(Scanner):
    sep = "::"
    ITEM = re.compile(
        r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?(?P<flags>(?:\b(?:default|async|const|unsafe|extern)\s+)*)"
        r"(?:\b(?P<kw>fn|struct|enum|union|trait|mod|impl|type|const|static|use|macro_rules!)\s*(?P<mut>mut\s+)?(?P<name>[A-Za-z_]\w*)?|\b(?P<block>extern)\s*(?=\{))"
    )

    def __init__(self, *args):
        super().__init__(*args)
        self.used, self.reexported, self.globs = [], [], []
        self.declared = set(DECLARED.findall(self.text))

    def scan_file(self) -> list[Entity]:
        if self.module == self.package:
            self.add("file", "", self.module.rsplit("::", 1)[-1], None, None, 0, len(self.text), qualified=self.module)
        for m in re.finditer(r"(\bpub(?:\s*\([^)]*\))?\s+)?\buse\s+([^;]+);", self.text):
            self.use(m[2], bool(m[1]))
        self.scan(0, len(self.text), self.module, "module")
        for e in self.found:
            if e.kind == "Module" and e.qualified == self.module:
                e.refs |= {"imports": [v for v in self.used if v], "reexports": self.reexported}
        return self.found

    def resolve(self, name: str) -> str:
        """As imported; else of this file, if it is declared here; else of the first module that is imported whole."""
        if name not in self.imports and name not in self.declared and self.globs:
            return f"{self.globs[0]}::{name}"
        return super().resolve(name)

    def use(self, tree: str, public: bool) -> None:

        def walk(prefix: str, part: str) -> None:
            part = part.strip()
            if "{" in part:
                head, inner = part.split("{", 1)
                depth, last, inner = 0, 0, inner.rsplit("}", 1)[0]
                for i, c in enumerate(inner + ","):
                    depth += (c == "{") - (c == "}")
                    if c == "," and depth == 0:
                        walk(prefix + head.strip(), inner[last:i])
                        last = i + 1
                return
            if not part:
                return
            path, _, alias = part.partition(" as ")
            target = self.absolute((prefix + path.strip()).removesuffix("::self"))
            name = alias.strip() or target.rsplit("::", 1)[-1]
            if name != "*":
                self.imports[name] = target
            elif not public:
                self.globs.append(target.removesuffix("::*"))
            (self.reexported if public else self.used).append(target)

        walk("", tree)

    def absolute(self, path: str) -> str:
        """crate, self and super paths from the package; other paths as they are."""
        parts = [p for p in path.split("::") if p]
        if parts[:1] == ["crate"]:
            parts = [self.package or "crate", *parts[1:]]
        elif parts[:1] in (["self"], ["super"]):
            base = self.module.split("::")
            while parts and parts[0] in ("self", "super"):
                base = base[:-1] if parts.pop(0) == "super" else base
            parts = base + parts
        return "::".join(parts)

    def call_target(self, path: str, name: str) -> str | list[str] | None:
        """Where a call goes: by the type of a receiver that is a parameter, one target for each bound of a generic one; else its bare name."""
        if path.endswith("."):
            owners = [self.owner] if path == "self." and self.owner else self.parameters.get(path[:-1], []) if path.count(".") == 1 else []
            return [f"{owner}::{name}" for owner in owners] or name
        if path:
            head, rest = path.rstrip(":").split("::")[0], path.rstrip(":").split("::")[1:]
            base = self.owner if head == "Self" and self.owner else self.absolute(head) if head in ("crate", "self", "super") else self.imports.get(head, head if head in STANDARD else self.resolve(head))
            return "::".join([base, *rest, name])
        return None if name[:1].isupper() else self.resolve(name)

    owner: str | None = None
    abi = "C"
    parameters: dict = {}

    def visibility(self, vis: str | None) -> str:
        v = re.sub(r"\s", "", vis or "")
        return "Private" if v in ("", "pub(self)") else "Public" if v == "pub" else "Internal"

    def scan(self, at: int, end: int, scope: str, inside: str, owner: str | None = None) -> None:
        while m := self.ITEM.search(self.text, at, end):
            kw, name, vis = m["kw"] or m["block"], m["name"], self.visibility(m["vis"])
            brace, stop = self.body(m.end(), end)
            at = max(stop, m.end())
            head = self.text[m.end() : brace if brace >= 0 else stop]
            if kw == "use" or (kw not in ("impl", "extern") and not name):
                continue
            place = name, scope, vis, m.start(), stop
            if kw == "fn":
                self.function(m, place, inside, owner, brace, head)
            elif kw == "mod":
                e = self.add(kw, inside, *place)
                if brace >= 0:
                    outer, self.module = self.module, e.qualified
                    self.scan(brace + 1, stop - 1, e.qualified, "module")
                    self.module = outer
            elif kw == "impl":
                self.implementation(m, scope, brace, stop, m.group(0)[len(m["vis"] or "") :].split("impl", 1)[1] + head)
            elif kw == "extern":
                abi = re.match(r'\s*r?#*"([^"]*)"', self.source[m.start("block") + len(kw) : brace])
                self.abi = abi[1] if abi else "C"
                self.add(kw, inside, "", *place[1:], facts={"abi": self.abi})
                self.scan(brace + 1, stop - 1, scope, "extern")
            elif kw == "macro_rules!":
                exported = "macro_export" in self.source[max(0, m.start() - 60) : m.start()]
                self.add(kw, inside, name, scope, "Public" if exported else "Private", m.start(), stop)
            elif kw == "trait":
                bounds = head.split("where")[0].partition(":")[2]
                e = self.add(kw, inside, *place, flags={"is_generic": generic(head)}, refs={"extended_types": [self.resolve(x) for x in TYPE_NAME.findall(re.sub(r"<[^>]*>", "", bounds))]})
                if brace >= 0:
                    self.scan(brace + 1, stop - 1, e.qualified, "trait", e.qualified)
            elif kw in ("struct", "union", "enum"):
                inner = brace if brace >= 0 else self.text.find("(", m.end(), stop)
                flags = {"is_generic": generic(head), "is_tuple_struct": brace < 0 <= inner, "is_unit_struct": inner < 0}
                e = self.add(kw, inside, *place, flags=flags, refs={"uses_types": [] if inner >= 0 else self.types(m.end(), stop)})
                if inner >= 0:
                    self.members(kw, e, brace, inner, stop)
            elif inside != "trait" or "=" in head:  # what a trait only asks for is no item
                declared = re.match(r"\s*:(?!:)([^=;]+)", head)
                flags = {"is_const": True, "is_mutable": m["mut"], "is_generic": generic(head)}
                self.add(kw, inside, *place, facts={"abi": self.abi}, flags=flags, details={"type": declared and declared[1]}, refs={"uses_types": self.types(m.end(), stop)})

    def members(self, kw: str, e: Entity, brace: int, a: int, stop: int) -> None:
        b = self.close.get(a, stop)
        parts, depth, last = [], 0, a + 1
        for i in range(a + 1, b + 1):
            c = self.text[i] if i < len(self.text) else ""
            depth += (c in ("(", "[", "{", "<")) - (c in (")", "]", "}") and i < b) - (c == ">" and self.text[i - 1] != "-")
            if i == b or (c == "," and depth <= 0):
                parts.append((last, i))
                last, depth = i + 1, 0
        n = 0
        for x, y in parts:
            s = re.sub(r"#\[[^\]]*\]", lambda m: " " * len(m[0]), self.text[x:y])
            m = re.match(r"\s*(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?P<name>[A-Za-z_]\w*)\s*)?(?P<rest>.*)$", s, re.S)
            if not s.strip():
                continue
            if kw == "enum":
                self.add("variant", "enum", m["name"], e.qualified, None, x, y)
            else:
                name, kind = (m["name"], x + s.find(":") + 1) if brace >= 0 else (str(n), x + (m.end("vis") if m["vis"] else 0))
                self.add("field", kw, name, e.qualified, self.visibility(m["vis"]), x, y, details={"type": self.text[kind:y]}, refs={"uses_types": self.types(kind, y)})
            n += 1

    def function(self, m, place, inside, owner, brace, head) -> None:
        name, scope, vis, start, stop = place
        form = "method" if re.search(r"\(\s*(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self\b", head) else "builder" if re.search(r"->\s*Self\s*(?:where\b|$)", head.rstrip("; \n\t")) else "fn"
        form = form if inside in ("impl", "trait-impl", "trait") else "fn"
        flags = {f"is_{x}": x in m["flags"].split() for x in ("async", "const", "unsafe")} | {"is_generic": generic(head)}
        bounds: dict[str, list[str]] = {}
        for k, v in re.findall(r"\b([A-Z]\w*)\s*:(?!:)\s*([^,>(){;=]+)", head):  # also of a where clause
            bounds.setdefault(k, []).extend(x for x in re.findall(r"(?:^|\+)\s*(?:\w+::)*([A-Z]\w*)", re.sub(r"<[^<>]*>?", "", v)))
        self.parameters = {}
        for k, several, first in re.findall(r"\b([a-z_]\w*)\s*:(?!:)\s*&?\s*(?:'\w+\s*)?(?:mut\s+)?(?:(?:dyn|impl)\s+((?:[^,()<>]|<[^<>]*>)+)|(?:\w+::)*([A-Z]\w*))", head):
            kinds = re.findall(r"(?:^|\+)\s*(?:\w+::)*([A-Z]\w*)", re.sub(r"<[^<>]*>", "", several)) if several else bounds.get(first, [first])
            self.parameters[k] = [self.resolve(x) for x in kinds]
        self.owner = owner
        refs = {"calls": self.calls(brace + 1, stop) if brace >= 0 else [], "uses_types": self.types(m.end(), stop)}
        e = self.add(form, inside, *place, facts={"abi": self.abi}, flags=flags, refs=refs)
        if owner and inside != "trait":
            e.aliases = [f"{owner}::{name}"]

    def implementation(self, m, scope, brace, stop, head) -> None:
        head = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", head.split("{")[0].split(" where ")[0]).strip()
        trait, _, target = head.rpartition(" for ")
        clean = lambda x: self.resolve(re.sub(r"<.*", "", x.strip().lstrip("&!"), flags=re.S).strip().split("::")[-1])
        of, form = clean(target), "trait-impl" if trait else "impl"
        facts = {"of": of, "trait": clean(trait) if trait else ""}
        e = self.add(form, "", "", scope, None, m.start(), stop, facts=facts, refs={"for_type": [of], "implements": [facts["trait"]] if trait else []})
        if brace >= 0:
            self.scan(brace + 1, stop - 1, e.name if trait else of, form, of)


def generic(head: str) -> bool:
    return bool(re.match(r"\s*<(?!\s*'\w+\s*>)", head))


class Script(Scanner):
    ITEM = re.compile(
        rf"(?P<export>\bexport\s+)?(?P<default>default\s+)?(?P<declare>declare\s+)?(?P<abstract>abstract\s+)?(?P<async>async\s+)?\b(?P<kw>function\b\s*\*?|(?:class|interface|const\s+enum|enum|type|namespace|module|global|const|let|var|import|export)\b)\s*(?P<name>{NAME})?"
    )
    MEMBER = re.compile(
        rf"(?P<mods>(?:\b(?:public|private|protected|static|readonly|abstract|async|override|declare|get|set)\s+)*)(?P<star>\*)?\s*(?P<name>#?{NAME}|\[[^\]]*\]|(?=[(<]))\s*(?P<opt>[?!])?\s*(?P<next>[(:=;<,\n}}])"
    )
    PARAMETER = re.compile(rf"(?<=[(,])\s*(?P<mods>(?:\b(?:public|private|protected|readonly|override)\s+)+)(?P<name>{NAME})\s*(?P<opt>\?)?")

    def scan_file(self) -> list[Entity]:
        refs = {"imports": [], "reexports": []}
        self.links(refs)
        self.add("file", "", self.module.rsplit(".", 1)[-1], None, None, 0, len(self.text), qualified=self.module, refs=refs)
        self.scan(0, len(self.text), self.module)
        return self.found

    def target(self, path: str) -> str:
        """Module name of an import path; what is not relative is external."""
        if not path.startswith("."):
            return f"external.{path}"
        base = self.module.split(".")[:-1]
        for part in path.split("/"):
            base = base[:-1] if part == ".." else base if part == "." else [*base, re.sub(r"\.(?:d\.ts|[cm]?[jt]sx?)$", "", part)]
        return ".".join(base)

    def links(self, refs: dict) -> None:
        for m in re.finditer(r"\b(import|export)\s+(?:type\s+)?([^;'\"]*?)\s*\bfrom\s*['\"]([^'\"]+)['\"]", self.source):
            module, clause, out = self.target(m[3]), m[2], []
            star = re.search(rf"\*(?:\s+as\s+({NAME}))?", clause)
            if star:
                out.append((star[1], module))
            braces = re.search(r"\{([^}]*)\}", clause)
            for part in (braces[1] if braces else "").split(","):
                if part.strip():
                    name, _, alias = part.replace("type ", "").strip().partition(" as ")
                    out.append((alias.strip() or name, f"{module}.{name.strip()}"))
            first = re.match(NAME, clause)
            if m[1] == "import" and first:
                out.append((first[0], f"{module}.default"))
            for name, target in out:
                if m[1] == "import" and name:
                    self.imports[name] = target
                refs["imports" if m[1] == "import" else "reexports"].append(target)

    def call_target(self, path: str, name: str) -> str | None:
        return name if path else self.resolve(name)

    def scan(self, at: int, end: int, scope: str, inside: str = "") -> None:
        while m := self.ITEM.search(self.text, at, end):
            kw, name = re.sub(r"[\s*]+", " ", m["kw"]).strip(), m["name"]
            vis = "Public" if m["export"] or m["declare"] else "Private"
            around = "ambient" if m["declare"] else inside
            brace, stop = self.body(m.end(), end)
            at = max(stop, m.end())
            if kw in ("import", "export"):
                at = m.end() if kw == "export" else at
                continue
            if kw in ("const", "let", "var"):
                at = max(self.variable(m, kw, name, scope, vis, end, around), m.end())
                continue
            if kw in ("namespace", "module", "global"):
                quoted = re.match(r"\s*['\"]([^'\"\n]+)['\"]", self.source[m.end("kw") : max(brace, m.end("kw"))])
                name = quoted[1] if quoted else name or (kw if kw == "global" and m["declare"] else None)
            name = name or ("default" if m["default"] else None)
            if not name or (kw in ("module", "namespace", "global") and brace < 0):
                at = m.end()
                continue
            place = name, scope, vis, m.start(), stop
            if kw == "function":
                flags = {"is_async": m["async"], "is_generator": "*" in m["kw"], "is_generic": generic(self.text[m.end() : stop])}
                self.add(kw, around, *place, flags=flags, refs=self.uses(m.end(), brace, stop))
            elif kw in ("class", "interface"):
                self.type_body(m, kw, place, brace, around, generic_at=m.end())
            elif kw in ("enum", "const enum"):
                e = self.add("enum", around, *place, flags={"is_const": kw != "enum"})
                for x in re.finditer(rf"(?:^|[,{{])\s*({NAME})", self.text[brace : stop - 1]) if e and brace >= 0 else ():
                    self.add("variant", "enum", x[1], e.qualified, None, brace + x.start(1), brace + x.end(1))
            elif kw == "type":
                semi = self.text.find(";", m.end(), end)
                stop = semi + 1 if semi >= 0 else stop
                at = max(stop, m.end())
                self.add(kw, around, name, scope, vis, m.start(), stop, flags={"is_generic": generic(self.text[m.end() : stop])}, refs={"uses_types": self.types(m.end(), stop)})
            elif e := self.add("namespace", around, *place):
                self.scan(brace + 1, stop - 1, e.qualified, "ambient" if m["declare"] else "")

    def uses(self, head: int, brace: int, stop: int) -> dict:
        return {"calls": self.calls(brace + 1, stop) if brace >= 0 else [], "uses_types": self.types(head, stop)}

    def variable(self, m, kw, name, scope, vis, end, around) -> int:
        line = re.compile(r"\s*(?::[^=;\n]*)?=\s*(?P<value>(?P<async>async\s+)?(?:function\b\s*(?P<star>\*)?|class\b|(?:<[^<>=]*>\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::\s*[^=\n]+)?=>))?").match(self.text, m.end())
        if line and line["value"]:
            at = line.end()
            while at < end and self.text[at] not in "{;\n":
                at = self.close.get(at, at) + 1 if self.text[at] in "([" else at + 1
            brace = at if at < end and self.text[at] == "{" else -1
            stop = self.close.get(at, end) + 1 if brace >= 0 else at
            if name and line["value"].startswith("class"):
                own = re.match(rf"\s+(?!extends\b|implements\b)({NAME})", self.text[line.end() : stop])
                self.type_body(m, "class-value", (own[1] if own else name, scope, vis, m.start(), stop), brace, around, generic_at=line.end() + (own.end() if own else 0))
            elif name:
                arrow = "=>" in line["value"]
                flags = {"is_async": line["async"], "is_arrow": arrow, "is_generator": line["star"]}
                refs = {"calls": self.calls(line.end(), stop), "uses_types": self.types(m.end(), stop)}
                self.add("arrow" if arrow else "function-value", around, name, scope, vis, m.start(), stop, flags=flags, refs=refs)
            return stop
        at = m.end()
        while at < end and self.text[at] not in ";\n":
            at = self.close.get(at, at) + 1 if self.text[at] in "([{" else at + 1
        if name:
            declared = re.match(r"\s*:([^=;\n]+)", self.text[m.end() : at])
            self.add(kw, around, name, scope, vis, m.start(), at, flags={"is_const": kw == "const"}, details={"type": declared and declared[1]}, refs={"uses_types": self.types(m.end(), at)})
        return at

    def type_body(self, m, form, place, brace, around, generic_at) -> None:
        stop, kw = place[4], "interface" if form == "interface" else "class"
        head = self.text[generic_at : max(brace, generic_at)]
        flags = {"is_abstract": m["abstract"], "is_generic": generic(head)}
        head = re.sub(r"<(?:[^<>]|<[^<>]*>)*>", "", head)
        names = lambda word: [self.resolve(x) for x in re.findall(NAME, (re.search(rf"\b{word}\b(.*?)(?=\bimplements\b|$)", head, re.S) or ["", ""])[1])]
        refs = {"extends": names("extends")[:1], "implements": names("implements"), "extended_types": names("extends"), "uses_types": self.types(brace, stop)}
        e = self.add(form, around, *place, flags=flags, refs=refs)
        at = brace + 1
        while e and brace >= 0 and (x := self.MEMBER.search(self.text, at, stop - 1)):
            at = max(self.member(x, kw, e.qualified, stop), x.end("name"), at + 1)

    def member(self, x, kw: str, scope: str, stop: int) -> int:
        """One member of a class or interface; the place behind it."""
        mods, name, after = x["mods"].split(), x["name"], x.end("name")
        is_method = x["next"] in "(<"
        if is_method:
            inner, end = self.body(after, stop - 1)
            if inner < 0 and kw == "interface":  # signatures end at commas and line breaks, too
                end = self.line_end(after, stop)
        else:
            inner, end = -1, self.line_end(after, stop)
        if name in NO_CALLS - {"constructor", "new"}:
            return end
        form, facts = "method" if is_method else "field", {}
        if name.startswith("["):
            key = re.match(rf"\[\s*{NAME}\s*:\s*([^\]]+?)\s*\]$", name)
            if not key:
                return end  # a computed name
            form, facts = "index", {"key": key[1]}
        elif not name:
            form = "call"
        elif name == "new" and is_method:
            form = "construct"
        elif is_method and "abstract" in mods:
            form = "abstract-method"
        own = "Private" if "private" in mods or name.startswith("#") else "Protected" if "protected" in mods else "Public"
        flags = {f"is_{k}": k in mods for k in ("static", "abstract", "async", "readonly")}
        flags |= {"is_getter": "get" in mods, "is_setter": "set" in mods, "is_generator": x["star"], "is_optional": x["opt"] == "?", "is_generic": x["next"] == "<"}
        declared = None if is_method else re.match(r"\s*[?!]?\s*:([^=;\n]+)", self.text[after:end])
        refs = self.uses(after, inner, end)
        if not is_method and kw == "class":
            refs["calls"] = self.calls(after, end)
        self.add(form, kw, name, scope, own, x.start(), end, facts=facts, flags=flags, details={"type": declared and declared[1].strip().rstrip(",")}, refs=refs)
        if name == "constructor" and is_method:
            self.parameters(x.start("next"), scope)
        return end

    def parameters(self, at: int, scope: str) -> None:
        """Parameters of a constructor that carry a modifier are properties of the class."""
        close = self.close.get(at, at)
        for p in self.PARAMETER.finditer(self.text, at, close):
            mods, end = p["mods"].split(), p.end()
            while end < close and self.text[end] != ",":
                end = self.close.get(end, end) + 1 if self.text[end] in "([{" else end + 1
            declared = re.match(r"\s*:([^=]+)", self.text[p.end() : end])
            own = "Private" if "private" in mods else "Protected" if "protected" in mods else "Public"
            self.add("parameter", "class", p["name"], scope, own, p.start("mods"), end, flags={"is_readonly": "readonly" in mods, "is_optional": p["opt"]}, details={"type": declared and declared[1]}, refs={"uses_types": self.types(p.end(), end)})

    def line_end(self, at: int, stop: int) -> int:
        while at < stop - 1 and self.text[at] not in ";\n,":
            at = self.close.get(at, at) + 1 if self.text[at] in "([{" else at + 1
        return min(at + 1, stop - 1)


def module_name(path: str, language: str, package: str | None, root: str = "src") -> str:
    parts = path.removeprefix(root + "/").split("/")
    stem = re.sub(r"\.(?:d\.)?\w+$", "", parts[-1])
    if language == "Rust":
        parts = parts[:-1] if stem in ("lib", "main", "mod") else [*parts[:-1], stem]
        return "::".join(x for x in [package, *parts] if x)
    parts = parts[:-1] if stem == "index" and len(parts) > 1 else [*parts[:-1], stem]
    return ".".join(parts)


def extract(source: str, path: str, package: str | None = None, root: str = "src", with_refs: bool = True, with_doc: bool = True) -> list[Entity]:
    """Entities of one file; a file of another language, or none, has none.  Calls, used types and documentation are looked for only if they are wanted."""
    language = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
    if not language or source is None:
        return []
    module = module_name(path, language, package, root)
    return (Rust if language == "Rust" else Script)(source, module, package, language, with_refs, with_doc).scan_file()


REFS = ("calls", "uses_types", "imports", "reexports", "implements", "extends", "extended_types")
ROWS = (
    "repository_id string, file_path string, entity_type string, name string, qualified_name string, parent_scope string, visibility string, language string, path_entity_identifier string, "
    "documentation_summary string, start_line long, end_line long, content string, rule string, flags map<string,boolean>, details map<string,string>, relationships struct<"
    + ",".join(f"{r}:array<struct<target:string,simple_name:string,is_external:boolean>>" for r in REFS)
    + ",for_type:struct<target:string,simple_name:string,is_external:boolean>,call_aliases:array<string>>"
)
#: Rows that a worker holds before it gives them out.
HELD_ROWS = 2048


def extract_table(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Entity rows of a table of files (repository_id, path, content, package); files are read where they lie, no shuffle.

    Of the columns only those named are made, all of them if none are.  A worker holds one batch of files and HELD_ROWS rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType.fromDDL(ROWS)
    wanted = StructType([whole[c] for c in columns or whole.names])
    schema, names = to_arrow_schema(wanted), set(wanted.names)

    def ref(target: str, package: str | None, sep: str):
        outside = target.startswith("external") or (sep == "::" and "::" in target and bool(package) and not target.startswith((package + "::", "<")))
        return {"target": target, "simple_name": re.split(r"::|\.", target)[-1], "is_external": outside}

    def relationships(e: Entity, package: str | None, sep: str) -> dict:
        refs = {k: [ref(t, package, sep) for t in e.refs.get(k, [])] for k in REFS}
        refs["for_type"] = ref(e.refs["for_type"][0], package, sep) if e.refs.get("for_type") else None
        return refs | {"call_aliases": e.aliases}

    def rows_of(repo, path, content, package):
        found = extract(content, path, package, with_refs="relationships" in names, with_doc="documentation_summary" in names)
        sep = "::" if path.endswith(".rs") else "."
        breaks = [m.start() for m in re.finditer("\n", content)] if found and names & {"start_line", "end_line"} else []
        make = {
            "repository_id": lambda e: repo,
            "file_path": lambda e: path,
            "entity_type": lambda e: e.kind,
            "name": lambda e: e.name,
            "qualified_name": lambda e: e.qualified,
            "parent_scope": lambda e: e.scope,
            "visibility": lambda e: e.visibility,
            "language": lambda e: EXTENSIONS[path.rsplit(".", 1)[-1].lower()],
            "path_entity_identifier": lambda e: f"{path}:{e.name}",
            "documentation_summary": lambda e: e.doc,
            "start_line": lambda e: bisect_left(breaks, e.start) + 1,
            "end_line": lambda e: bisect_left(breaks, e.end) + 1,
            "content": lambda e: content[e.start : e.end],
            "rule": lambda e: e.rule,
            "flags": lambda e: list(e.flags.items()),
            "details": lambda e: list(e.details.items()),
            "relationships": lambda e: relationships(e, package, sep),
        }
        makers = [make[c] for c in schema.names]
        return [[f(e) for f in makers] for e in found]

    def given(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            rows = []
            for file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += rows_of(*file)
                while len(rows) >= HELD_ROWS:
                    yield given(rows[:HELD_ROWS])
                    rows = rows[HELD_ROWS:]
            yield given(rows)

    return files.select("repository_id", "path", "content", "package").mapInArrow(run, wanted)
