"""Extractors for program text: Python by its syntax tree, the others by patterns over code without comments and strings."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from itertools import accumulate

from lodestack.extract.common import Batch, Lines, blanked, closing, rng


def python(path: str, text: str) -> Batch:
    """Module, functions and classes with dotted names, signature and docstring; imports and calls as references."""
    b = Batch(path, "python")
    top = b.module(text)
    lines = text.split("\n")

    def at(n: ast.AST) -> dict:
        return rng(n.lineno, n.col_offset, n.end_lineno or n.lineno, n.end_col_offset or 0)

    def visit(n: ast.AST, owner: str, scope: str) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{c.name}" if scope else c.name
                me = b.node("class" if isinstance(c, ast.ClassDef) else "function", c.name, name, at(c), lines[c.lineno - 1].strip(), ast.get_docstring(c))
                b.edge(owner, me, "contains", at(c), "parser", 1.0)
                visit(c, me, name)
                continue
            if isinstance(c, ast.Import):
                for a in c.names:
                    b.ref(owner, a.name.rsplit(".", 1)[-1], "import", at(c), 0.8, module=a.name)
            elif isinstance(c, ast.ImportFrom):
                for a in c.names:
                    b.ref(owner, a.name, "import", at(c), 0.8, module="." * c.level + (c.module or ""))
            elif isinstance(c, ast.Call):
                f = c.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if name:
                    b.ref(owner, name, "call", at(c), 0.8)
            visit(c, owner, scope)

    visit(ast.parse(text), top, "")
    return b


_JS = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\*?\s+(?P<function>[A-Za-z_$][\w$]*)|(?:abstract\s+)?class\s+(?P<class>[A-Za-z_$][\w$]*)|(?:declare\s+)?(?:interface|type|enum)\s+(?P<type>[A-Za-z_$][\w$]*)|(?:const|let|var)\s+(?P<constant>[A-Za-z_$][\w$]*)\s*(?P<arrow>(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>)?)",
    re.M,
)
_JS_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?::[^{;=\n]+)?\{", re.M)
_JS_IMPORT = re.compile(r"^[ \t]*(?P<kind>import|export)\s+(?:type\s+)?(?P<names>[^'\";]*?)\s*(?:from\s*)?(?P<q>['\"])(?P<module>[^'\"\n]+)(?P=q)", re.M)


def _depths(code: str):
    """A function that tells how many braces are open before a position."""
    at = [m.start() for m in re.finditer("[{}]", code)]
    depth = [0, *accumulate(1 if code[i] == "{" else -1 for i in at)]
    return lambda position: depth[bisect_left(at, position)]


def javascript(path: str, text: str, language: str = "javascript") -> Batch:
    """Functions, classes, methods, constants and types; references only from imports and re-exports."""
    b = Batch(path, language)
    top, code, pos = b.module(text), blanked(text, "//", ("/*", "*/"), "'\"`"), Lines(text)
    depth = _depths(code)
    for m in _JS.finditer(code):
        kind = next(k for k in ("function", "class", "type", "constant") if m[k])
        name = m[kind]
        if kind == "constant" and depth(m.start()):
            continue  # only constants of the module
        end = closing(code, m.end()) if kind in ("function", "class") or m["arrow"] else m.end()
        me = b.node("function" if m["arrow"] else kind, name, name, pos.span(m.start(), end), text[m.start() : text.find("\n", m.start()) % (len(text) + 1)].strip())
        b.edge(top, me, "contains", None, "parser", 1.0)
        if kind == "class":
            body = code[m.end() : end]
            for k in _JS_METHOD.finditer(body):
                if k["name"] not in ("if", "for", "while", "switch", "catch", "function", "return") and depth(m.end() + k.start()) - depth(m.end()) == 1:
                    at = m.end() + k.start()
                    child = b.node("method", k["name"], f"{name}.{k['name']}", pos.span(at, closing(code, m.end() + k.end() - 1)), k[0].strip())
                    b.edge(me, child, "contains", None, "parser", 1.0)
    for m in _JS_IMPORT.finditer(text):
        if code[m.start() : m.end()].lstrip().startswith(("import", "export")):
            for part in re.split(r"[,{}]", m["names"]):
                name = re.split(r"\s+as\s+", part.strip())[0].strip()
                if re.fullmatch(r"[A-Za-z_$][\w$]*", name or "") and name not in ("type", "from"):
                    b.ref(top, name, "import" if m["kind"] == "import" else "re_export", pos.span(m.start(), m.end()), 0.65 if m["kind"] == "import" else 0.55, module=m["module"])
    return b


def typescript(path: str, text: str) -> Batch:
    return javascript(path, text, "typescript")


_GO_IMPORT = re.compile(r"^\s*(?:import\s+)?(?:(?P<alias>[A-Za-z_.][\w]*)\s+)?\"(?P<path>[^\"]+)\"\s*$", re.M)
_GO_DEF = re.compile(r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<func>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(|^type\s+(?P<type>[A-Za-z_]\w*)", re.M)
_GO_KEYWORDS = ["if", "for", "switch", "select", "return", "func", "go", "defer", "range", "case", "append", "len", "cap", "make", "new", "panic", "print", "println", "copy", "delete", "close", "recover", "string", "int", "error", "byte", "rune", "float64", "int64", "bool"]


def go(path: str, text: str) -> Batch:
    """Package, imports, types, functions and methods; selector and identifier calls as references."""
    b = Batch(path, "go")
    top, code, pos = b.module(text), blanked(text, "//", ("/*", "*/"), "\"`'"), Lines(text)
    package = re.search(r"^package\s+(\w+)", code, re.M)
    scope = package[1] if package else ""
    if package:
        b.node("package", scope, scope, pos.span(package.start(), package.end()))
    imports: dict[str, str] = {}
    block = re.search(r"^import\s*\(", code, re.M)
    regions = [(m.start(), m.end()) for m in re.finditer(r"^import\s+[^(\n]*$", code, re.M)] + ([(block.end(), closing(code, block.end() - 1, "(", ")"))] if block else [])
    for lo, hi in regions:
        for m in _GO_IMPORT.finditer(text, lo, hi):
            alias = m["alias"] or m["path"].rsplit("/", 1)[-1]
            imports[alias] = m["path"]
            node = b.node("import", alias, m["path"], pos.span(m.start("path"), m.end("path")))
            b.edge(top, node, "contains", None, "parser", 1.0)
    for m in _GO_DEF.finditer(code):
        if m["type"]:
            b.edge(top, b.node("type", m["type"], f"{scope}.{m['type']}", pos.span(m.start(), closing(code, m.end()) if "{" in code[m.end() : m.end() + 40] else m.end())), "contains", None, "parser", 1.0)
            continue
        end = closing(code, m.end())
        recv = re.sub(r"[\[\]*].*|^.*\s\*?|\*", "", m["recv"].strip()) if m["recv"] else None
        me = b.node("method" if recv else "function", m["func"], f"{scope}.{recv}.{m['func']}" if recv else f"{scope}.{m['func']}", pos.span(m.start(), end), text[m.start() : text.find("\n", m.start()) % (len(text) + 1)].strip())
        b.edge(top, me, "contains", None, "parser", 1.0)
        for c in re.finditer(r"(?:(?P<x>[A-Za-z_]\w*)\.)?(?P<f>[A-Za-z_]\w*)\(", code[m.end() : end]):
            if c["f"] in _GO_KEYWORDS:
                continue
            at = pos.span(m.end() + c.start(), m.end() + c.end())
            if c["x"]:
                known = c["x"] in imports
                b.ref(me, c["f"], "go_selector", at, 0.7 if known else 0.6, receiver="import_selector" if known else "receiver_or_package_local", import_dir=imports.get(c["x"]))
            else:
                b.ref(me, c["f"], "go_identifier", at, 0.7)
    return b


_CPP_CLASS = re.compile(r"^\s*(?:template\s*<[^>]*>\s*)?(class|struct)\s+([A-Za-z_]\w*)(?=[^;()]*\{|[^;()]*$)")
_CPP_FUNC = re.compile(r"^\s*(?P<type>[A-Za-z_][\w:<>,*&\s~]*?[\s*&])?(?P<name>~?[A-Za-z_]\w*(?:::~?[A-Za-z_]\w*)*)\s*\((?P<args>[^;{}]*)\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{]*)?(?P<open>\{|(?:=\s*(?:0|default|delete)\s*)?;|$)")
_CPP_INCLUDE = re.compile(r"\s*#\s*include\s*[<\"]([^>\"]+)[>\"]")
_CPP_WORDS = ["if", "for", "while", "switch", "return", "catch", "sizeof", "else", "do", "case", "new", "delete", "throw", "alignof", "decltype", "static_cast"]


def cpp(path: str, text: str, language: str = "cpp") -> Batch:
    """Includes, classes, methods and functions, with and without bodies; includes and calls of functions of the file as references.

    Methods are named Class.method, whether they stand in their class or outside; functions by file and name. Nesting
    follows the depth of braces in code without comments and strings.
    """
    b = Batch(path, language)
    top = b.module(text)
    raw_lines, code = text.split("\n"), blanked(text, "//", ("/*", "*/"), "\"'").split("\n")
    of_file = path.rsplit(".", 1)[0].replace("/", ".")
    depth, stack, defined, calls = 0, [], {}, []
    for k, line in enumerate(code, 1):
        raw = raw_lines[k - 1].rstrip("\r")
        if re.match(r"\s*#\s*include\b", line):
            found = _CPP_INCLUDE.match(raw)
            if found:
                name = found[1]
                me = b.node("include", name, f"{path}:include:{name}", rng(k, raw.index("#"), k, len(raw)), raw.strip())
                b.edge(top, me, "contains", None, "parser", 1.0)
                b.ref(me, re.sub(r"\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$", "", name.rsplit("/", 1)[-1]), "cpp_include", rng(k, found.start(1), k, found.end(1)), 0.35, include_path=name)
            continue
        c, f = _CPP_CLASS.match(line), _CPP_FUNC.match(line)
        classes = [s for s in stack if s[0] == "class"]
        in_function = any(s[0] == "function" for s in stack)
        owner = classes[-1][3] if classes else top
        if c and not in_function:
            me = b.node("class", c[2], ".".join([*(s[1] for s in classes), c[2]]), rng(k, line.index(c[1]), k, len(raw)), raw.strip())
            b.edge(owner, me, "contains", None, "parser", 1.0)
            stack.append(("class", c[2], depth, me))
        elif f and not in_function and f["name"].split("::")[-1] not in _CPP_WORDS and (f["type"] or "").split(" ")[0].strip() not in _CPP_WORDS:
            name = f["name"].split("::")[-1]
            body = f["open"] == "{" or not f["open"] and k < len(code) and code[k].lstrip().startswith("{")
            own = name.lstrip("~") == classes[-1][1] if classes else False  # constructors and destructors name no type
            if body or f["open"].endswith(";") and (f["type"] or own) and "=" not in line[: f.start("name")]:
                scope = [s[1] for s in classes] + f["name"].split("::")[:-1]
                me = b.node("method" if scope else "function", name, ".".join([*scope, name]) if scope else f"{of_file}.{name}", rng(k, f.start("name"), k, len(raw)), raw.strip().rstrip("{").strip(), body=bool(body))
                b.edge(owner, me, "contains", None, "parser", 1.0)
                if body:
                    defined.setdefault(name, me)
                    stack.append(("function", name, depth, me))
                    line = line[f.end() - 1 :] if f["open"] else ""
        if in_function or stack and stack[-1][0] == "function":
            inside = next(s for s in reversed(stack) if s[0] == "function")
            calls += [(inside[3], m[1], k, m.start()) for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", line) if m[1] not in _CPP_WORDS and m[1] != inside[1]]
        for ch in code[k - 1]:
            if ch == "{":
                depth += 1
            elif ch == "}":
                depth -= 1
                while stack and depth <= stack[-1][2]:
                    stack.pop()
    for inside, name, k, col in calls:
        if name in defined:
            b.ref(inside, name, "call", rng(k, col, k, col + len(name)), 0.4)
    return b


def c(path: str, text: str) -> Batch:
    return cpp(path, text, "c")


# Words of the language and its web framework that make references.
RUBY_REQUIRE = ["require", "require_relative", "load", "autoload", "autoload_relative"]
RUBY_MIXIN = ["include", "extend", "prepend"]
RUBY_ROUTES = ["get", "post", "put", "patch", "delete", "resource", "resources", "match", "root", "draw", "concern", "concerns"]
RUBY_MODEL = ["belongs_to", "has_many", "has_one", "has_and_belongs_to_many", "validates", "before_save", "before_create", "before_update", "before_destroy", "before_validation"]
_RUBY_OPEN = re.compile(r"^\s*(?:if|unless|while|until|case|begin|for)\b|(?:=|<<)\s*(?:if|case|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def ruby(path: str, text: str) -> Batch:
    """Modules, classes, singleton classes, methods, constants and route concerns, by a stack of open blocks; static and dynamic references."""
    b = Batch(path, "ruby")
    top = b.module(text)
    code, raw = blanked(text, "#", ("=begin", "=end"), "\"'").split("\n"), text.split("\n")
    stack: list[tuple[str, str, str]] = []
    routes = path.endswith("config/routes.rb") or "/config/routes/" in path

    def scope() -> str:
        return "::".join(n for k, n, _ in stack if k in ("module", "class") and n)

    def owner() -> str:
        return next((i for k, _, i in reversed(stack) if k != "block" and i), top)

    for k, (line, full) in enumerate(zip(code, raw), 1):
        at = rng(k, len(line) - len(line.lstrip()), k, len(full))
        own, prefix = owner(), scope()
        m = re.match(r"\s*(module|class)\s+(<<\s*self|[A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?", line)
        d = re.match(r"\s*(?:private\s+|public\s+|protected\s+)?def\s+(self\.)?([A-Za-z_]\w*[?!=]?|[-+*/<>=\[\]!~%&|^]+)", line)
        if m:
            if m[2].startswith("<<"):
                name = prefix.split("::")[-1]
                stack.append(("singleton_class", "", b.node("singleton_class", name, f"{prefix}.self", at)))
            else:
                qualified = "::".join(filter(None, (prefix, m[2])))
                me = b.node(m[1], m[2].split("::")[-1], qualified.replace("::", "."), at, full.strip())
                b.edge(own, me, "contains", None, "parser", 1.0)
                if m[3]:
                    b.ref(me, m[3], "inheritance", at, 0.75)
                if not re.search(r";\s*end\s*$", line):
                    stack.append((m[1], m[2], me))
            continue
        if d:
            single = bool(d[1]) or any(s[0] == "singleton_class" for s in stack)
            me = b.node("singleton_method" if single else "method", d[2], (prefix.replace("::", ".") + "." if prefix else "") + d[2], at, full.strip())
            b.edge(own, me, "contains", None, "parser", 1.0)
            if not re.search(r"\bend\s*$|\)\s*=\s|\bdef\s+\S+\s*=\s", line):
                stack.append(("method", d[2], me))
            continue
        if re.match(r"\s*end\b", line):
            if stack:
                stack.pop()
            continue
        w = re.match(r"\s*([a-z_]\w*)\b[ (]*(.*)$", full)
        word, rest = (w[1], w[2]) if w and line.strip() else ("", "")
        literal = re.match(r":?[\"']?([\w:/.#-]+)", rest)
        quoted = re.match(r"[\"']([^\"'#]*)[\"']|:(\w+)|([A-Z][\w:]*)", rest)
        known = {**dict.fromkeys(RUBY_REQUIRE, "require"), **dict.fromkeys(RUBY_MIXIN, "mixin"), **dict.fromkeys(RUBY_MODEL, "model"), **(dict.fromkeys(RUBY_ROUTES, "route") if routes else {})}
        if word in known:
            kind = {"require": word if word in ("require", "require_relative") else "load", "mixin": word, "model": "model_dsl", "route": "route"}[known[word]]
            if known[word] == "route" and word == "concern" and quoted:
                b.node("rails_route_concern", quoted[2] or quoted[1], None, at)
            target = re.search(r"(?:=>|to:)\s*[\"']([\w/]+#\w+)[\"']", rest) if kind == "route" else None
            option = {o: v for o, v in re.findall(r"\b(class_name|through|source|source_type|as|polymorphic):\s*[:\"']?([\w:]+)", rest)}
            if quoted or target:
                name = target[1] if target else next(g for g in quoted.groups() if g is not None)
                if kind == "model_dsl":
                    name = option.get("class_name") or pascal(singular(name))
                b.ref(own, name, kind, at, 0.75, word=word, **option)
            elif literal or rest:
                b.ref(own, word, "ruby_dynamic", at, 0.2, static=False, reason="non_literal_argument")
        elif word in ("alias", "alias_method") and literal:
            b.ref(own, literal[1], "alias", at, 0.75)
        elif word in ("private", "public", "protected", "module_function"):
            b.ref(own, literal[1] if literal else word, "visibility", at, 0.75, static=bool(literal))
        elif word in ("send", "public_send", "define_method", "instance_eval", "class_eval", "eval", "const_get"):
            b.ref(own, word, "ruby_dynamic", at, 0.2, static=False, reason="dynamic_dispatch")
        else:
            const = re.match(r"\s*([A-Z][A-Z0-9_]*)\s*=[^=~>]", line)
            if const:
                b.edge(own, b.node("constant", const[1], ".".join(filter(None, (prefix.replace("::", "."), const[1]))), at), "contains", None, "parser", 1.0)
            for x in re.finditer(r"(?<![\w:.])([A-Z]\w*(?:::[A-Z]\w*)*)(?:\.([a-z_]\w*[?!]?))?", line):
                if not const or x[1] != const[1]:
                    b.ref(own, x[1], "constant", rng(k, x.start(), k, x.end(1)), 0.75)
                    if x[2]:
                        b.ref(own, x[2], "call", rng(k, x.start(2), k, x.end(2)), 0.75, receiver_name=x[1])
            for x in re.finditer(r"(?<![\w.:@$])([a-z_]\w*[?!]?)\(", line):
                b.ref(own, x[1], "call", rng(k, x.start(1), k, x.end(1)), 0.75)
        if _RUBY_OPEN.search(line) and not re.search(r"\bend\s*$", line):
            stack.append(("block", "", ""))
    return b


def singular(word: str) -> str:
    return word[:-4] if word.endswith("_ids") else word[:-3] + "y" if word.endswith("ies") else word[:-1] if word.endswith("s") else word


def pascal(word: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in word.split("_"))
