"""Resource extractors: templates of cloud stacks, CMake, .NET projects, and a node for any other file."""

from __future__ import annotations

import re

from lodestack.extract.common import Batch, Lines, rng

_FUNCTIONS = ("AWS::Serverless::Function", "AWS::Lambda::Function")


def _loader():
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def short(loader, suffix, node):
        if isinstance(node, yaml.ScalarNode):
            value = loader.construct_scalar(node)
        elif isinstance(node, yaml.SequenceNode):
            value = loader.construct_sequence(node, deep=True)
        else:
            value = loader.construct_mapping(node, deep=True)
        return {"Ref" if suffix == "Ref" else f"Fn::{suffix}": value}

    Loader.add_multi_constructor("!", short)
    return yaml, Loader


def is_template(text: str) -> bool:
    return bool(re.search(r"^AWSTemplateFormatVersion|^Transform:\s*['\"]?AWS::Serverless|^Resources:", text, re.M))


def cloudformation(path: str, text: str) -> Batch:
    """Resources, functions with handler bindings, event sources; Ref, GetAtt, Sub, ImportValue and DependsOn as references.

    Text that the parser refuses is read line by line: logical ids and types only.
    """
    b = Batch(path, "yaml")
    top = b.node("cloudformation_template", path.rsplit("/", 1)[-1], path, rng(1, 0, text.count("\n") + 1, 0))
    where = {m[1]: i for i, line in enumerate(text.split("\n"), 1) if (m := re.match(r"  ([A-Za-z0-9]+):\s*$", line))}
    try:
        yaml, loader = _loader()
        tree = yaml.load(text, Loader=loader)  # noqa: S506  a safe loader with tags as data
        resources = tree.get("Resources") if isinstance(tree, dict) else None
    except Exception:  # noqa: BLE001  any refusal leads to the line scan
        resources, tree = None, None
    if not isinstance(resources, dict):
        for name, line in where.items():
            kind = re.search(r"^\s+Type:\s*['\"]?([\w:]+)", "\n".join(text.split("\n")[line : line + 6]), re.M)
            if kind and "::" in kind[1]:
                b.edge(top, b.node("cloudformation_resource", name, f"{path}#{name}", rng(line, 2, line, 2 + len(name)), kind[1], None, parse="line_scan"), "routes_to_template_resource", None, "infra_parser", 0.7)
        return b
    globals_ = ((tree.get("Globals") or {}).get("Function") or {}) if isinstance(tree.get("Globals"), dict) else {}
    for name, r in resources.items():
        if not isinstance(r, dict):
            continue
        kind, props = str(r.get("Type", "")), r.get("Properties") if isinstance(r.get("Properties"), dict) else {}
        line = where.get(str(name), 1)
        at = rng(line, 2, line, 2 + len(str(name)))
        function = kind in _FUNCTIONS
        me = b.node("lambda_function" if function else "cloudformation_resource", str(name), f"{path}#{name}", at, kind)
        b.edge(top, me, "routes_to_template_resource", at, "cloudformation", 0.7)
        if function:
            handler, uri = props.get("Handler", globals_.get("Handler")), props.get("CodeUri", globals_.get("CodeUri", "."))
            if isinstance(handler, str):
                binding = b.node("lambda_handler", handler, f"{path}#{name}.{handler}", at, None, None, logical_id=str(name), template=path)
                b.edge(me, binding, "binds_handler", at, "cloudformation", 0.7)
                base = "/".join(p for p in (path.rsplit("/", 1)[0] if "/" in path else "", str(uri).strip("./") if isinstance(uri, str) else "") if p)
                stem = handler.rsplit(".", 1)[0].replace(".", "/")
                paths = [f"{base}/{stem}{x}" if base else f"{stem}{x}" for x in (".py", ".ts", ".js", ".mjs", ".rb", ".go")]
                b.ref(binding, handler.rsplit(".", 1)[-1], "lambda_handler_file", at, 0.7, paths=paths)
            for event, spec in (props.get("Events") or {}).items() if isinstance(props.get("Events"), dict) else ():
                e = b.node("lambda_event_source", str(event), f"{path}#{name}.{event}", at, str(spec.get("Type")) if isinstance(spec, dict) else None)
                b.edge(e, me, "lambda_event_source", at, "cloudformation", 0.7)
        for dep in [r["DependsOn"]] if isinstance(r.get("DependsOn"), str) else r.get("DependsOn") or []:
            b.ref(me, str(dep), "cfn_depends_on", at, 0.85)
        todo = [props]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                for k, v in x.items():
                    if k == "Ref" and isinstance(v, str) and not v.startswith("AWS::"):
                        b.ref(me, v, "cfn_ref", at, 0.75)
                    elif k == "Fn::GetAtt" and v:
                        b.ref(me, str(v[0] if isinstance(v, list) else v).split(".")[0], "cfn_get_att", at, 0.75)
                    elif k == "Fn::Sub":
                        for s in re.findall(r"\$\{([A-Za-z0-9]+)(?:\.[^}]*)?\}", str(v[0] if isinstance(v, list) and v else v)):
                            b.ref(me, s, "cfn_sub", at, 0.55)
                    elif k == "Fn::ImportValue":
                        b.ref(me, str(v), "cfn_import_value", at, 0.35)
                    todo.append(v)
    return b


def cmake(path: str, text: str) -> Batch:
    """Targets of a CMakeLists.txt, one node each, with all that stands behind the name but generator expressions as sources."""
    b, pos = Batch(path, "text"), Lines(text)
    for m in re.finditer(r"^[ \t]*add_(library|executable)\s*\(\s*([A-Za-z_][\w.:+-]*)([^)]*)\)", text, re.M):
        sources = [s for s in m[3].split() if not s.startswith("$<")]
        b.node(f"cmake_{m[1]}", m[2], f"{path}:{m[2]}", pos.span(m.start(), m.end()), m[0].strip(), None, sources=sources)
    return b


def dotnet(path: str, text: str) -> Batch:
    """Projects of a solution (those of a C#, F# or Visual Basic project file), or the project of a project file."""
    b, pos = Batch(path, "config"), Lines(text)
    if path.lower().endswith(".sln"):
        for m in re.finditer(r'^Project\("[^"]+"\)\s*=\s*"([^"]+)",\s*"([^"]+\.(?:csproj|fsproj|vbproj))",\s*"([^"]+)"', text, re.M):
            target = m[2].replace("\\", "/")
            b.node("dotnet_solution_project", m[1], f"{path}:{m[1]}", pos.span(m.start(), m.end()), target, None, project=target, guid=m[3])
    else:
        tag = lambda t: [v.strip() for v in re.findall(rf"(?i)<{t}\b[^>]*>([^<]*)</{t}>", text)]
        include = lambda t: re.findall(rf"(?i)<{t}\b[^>]*?\bInclude\s*=\s*[\"']([^\"']+)[\"']", text)
        root = re.search(r"(?i)<Project\b([^>]*)>", text)
        sdk = re.search(r"(?i)\bSdk\s*=\s*[\"']([^\"']+)[\"']", root[1]) if root else None
        packages, projects = include("PackageReference"), [r.replace("\\", "/") for r in include("ProjectReference")]
        frameworks = sorted({f.strip() for v in tag("TargetFrameworks") + tag("TargetFramework") for f in v.split(";") if f.strip()})
        test = any(v.lower() == "true" for v in tag("IsTestProject")) or any(p.lower() in TEST_PACKAGES for p in packages)
        me = b.node("dotnet_project", path.rsplit("/", 1)[-1], path, rng(1, 0, text.count("\n") + 1, 0), ";".join(frameworks) or (sdk[1] if sdk else None), None, sdk=sdk[1] if sdk else None, frameworks=frameworks, output=(tag("OutputType") or [None])[0], packages=packages, projects=projects, test=test, warnings=[] if root else ["no Project element"])
        for r in projects:
            b.ref(me, r.rsplit("/", 1)[-1], "project_reference", None, 0.8)
    return b


# Packages that make a project one of tests.
TEST_PACKAGES = ["xunit", "nunit", "mstest.testframework"]
RAILS_ROLES = [("controller", r"(^|/)app/controllers/"), ("model", r"(^|/)app/models/"), ("view", r"(^|/)app/views/"), ("job", r"(^|/)app/jobs/"), ("mailer", r"(^|/)app/mailers/"), ("routes", r"(^|/)config/routes(\.rb$|/)"), ("migration", r"(^|/)db/migrate/"), ("test", r"(^|/)(test|spec)/")]


def generic(path: str, text: str, language: str) -> Batch:
    b = Batch(path, language)
    role = next((r for r, regex in RAILS_ROLES if re.search(regex, path)), None)
    b.node("resource", path.rsplit("/", 1)[-1], path, rng(1, 0, text.count("\n") + 1, 0), None, None, **({"rails_role": role} if role else {}))
    return b
