"""Extractors and the file source on trees written here."""

import json

import pytest

from lodestack.extract import languages, registry, resources
from lodestack.extract.registry import extract_one
from lodestack.sources import files as F_


def names(b, kind):
    return [n["qualified_name"] for n in b.nodes if n["kind"] == kind]


def refs(b, kind):
    return [r["name"] for r in b.refs if r["kind"] == kind]


def test_python():
    b = languages.python("pkg/run.py", 'import os.path\nfrom a.b import c\n\nclass Runner:\n    """Runs."""\n    def run(self):\n        helper(1)\n        os.path.join("x")\n\ndef helper(n):\n    return n\n')
    assert names(b, "class") == ["Runner"] and names(b, "function") == ["Runner.run", "helper"]
    assert refs(b, "call") == ["helper", "join"] and refs(b, "import") == ["path", "c"]
    assert next(n for n in b.nodes if n["name"] == "Runner")["docstring"] == "Runs."


def test_javascript():
    b = languages.typescript("src/a.ts", 'import { x, y as z } from "./m";\nexport { q } from "./n";\n// function no() {}\nexport class A extends B {\n  async go(n: number): Promise<void> {\n    if (n) { }\n  }\n}\nexport const k = 1;\nconst f = async (a) => { const inner = 2; };\ninterface I { a: string }\nfunction* gen() { return "function fake() {}"; }\n')
    assert names(b, "class") == ["A"] and names(b, "method") == ["A.go"] and names(b, "type") == ["I"]
    assert set(names(b, "function")) == {"f", "gen"} and names(b, "constant") == ["k"]
    assert refs(b, "import") == ["x", "y"] and refs(b, "re_export") == ["q"]


def test_go():
    b = languages.go("svc/main.go", 'package main\n\nimport (\n\t"fmt"\n\tst "example.org/store"\n)\n\ntype Server struct { n int }\n\nfunc (s *Server) Run() {\n\tst.Open("x")\n\ts.stop()\n\tlocal()\n}\n\nfunc local() { fmt.Println("func fake() {") }\n')
    assert names(b, "method") == ["main.Server.Run"] and names(b, "function") == ["main.local"] and names(b, "type") == ["main.Server"] and names(b, "import") == ["fmt", "example.org/store"]
    got = {(r["name"], r["kind"], r["confidence"], r["receiver"]) for r in b.refs}
    assert ("Open", "go_selector", 0.7, "import_selector") in got and ("stop", "go_selector", 0.6, "receiver_or_package_local") in got and ("local", "go_identifier", 0.7, None) in got


def test_cpp():
    b = languages.cpp("a.cpp", '#include "lib/util.h"\n#include <vector>\nclass Box {\npublic:\n  int size() const {\n    return count();\n  }\n};\nint count() { return 1; }\nvoid Box::grow(int n)\n{\n  if (n) { count(); }\n}\nint declared(int);\n')
    assert names(b, "class") == ["Box"] and names(b, "method") == ["Box.size", "Box.grow"] and names(b, "function") == ["a.count", "a.declared"]
    assert names(b, "include") == ["a.cpp:include:lib/util.h", "a.cpp:include:vector"]
    assert refs(b, "cpp_include") == ["util", "vector"] and refs(b, "call") == ["count", "count"]
    h = languages.cpp("inc/box.hpp", 'struct Outer {\n  Outer();\n  ~Outer();\n  virtual int area() const = 0;\n  class Inner {\n    static void go(int a, int b);\n  };\n  int later;\n};\n// int hidden();\nextern int helper(const char *name);\nint x = f(3);\n')
    assert names(h, "class") == ["Outer", "Outer.Inner"] and names(h, "method") == ["Outer.Outer", "Outer.~Outer", "Outer.area", "Outer.Inner.go"] and names(h, "function") == ["inc.box.helper"]
    assert not [json.loads(n["metadata"]) for n in h.nodes if json.loads(n["metadata"]).get("body")]


def test_ruby():
    b = languages.ruby("app/models/post.rb", "require 'json'\nmodule Blog\n  class Post < Base\n    LIMIT = 3\n    include Searchable\n    belongs_to :author\n    has_many :comments, class_name: 'Blog::Note'\n    def title\n      if x\n        Helper.clean(name)\n      end\n    end\n    def self.all; end\n    class << self\n      def recent\n        items.each do |i|\n          show(i)\n        end\n      end\n    end\n    send(kind)\n  end\nend\n")
    assert names(b, "class") == ["Blog.Post"] and names(b, "method") == ["Blog.Post.title"] and set(names(b, "singleton_method")) == {"Blog.Post.all", "Blog.Post.recent"}
    assert refs(b, "inheritance") == ["Base"] and refs(b, "include") == ["Searchable"] and refs(b, "model_dsl") == ["Author", "Blog::Note"]
    assert "Helper" in refs(b, "constant") and "clean" in refs(b, "call") and refs(b, "ruby_dynamic") == ["send"] and names(b, "constant") == ["Blog.Post.LIMIT"]
    r = languages.ruby("config/routes.rb", "Rails.application.routes.draw do\n  get '/x', to: 'posts#index'\n  resources :posts\nend\n")
    assert refs(r, "route") == ["posts#index", "posts"]


TEMPLATE = """AWSTemplateFormatVersion: '2010-09-09'
Transform: AWS::Serverless-2016-10-31
Resources:
  Table:
    Type: AWS::DynamoDB::Table
  Fn:
    Type: AWS::Serverless::Function
    DependsOn: Table
    Properties:
      Handler: app.main
      CodeUri: src/
      Environment:
        Variables:
          A: !Ref Table
          B: !GetAtt Table.Arn
          C: !Sub "${Table}-x"
          D: !ImportValue shared
      Events:
        Hit:
          Type: Api
"""


def test_resources():
    b = resources.cloudformation("infra/template.yaml", TEMPLATE)
    assert {(r["name"], r["kind"], r["confidence"]) for r in b.refs} >= {("Table", "cfn_ref", 0.75), ("Table", "cfn_get_att", 0.75), ("Table", "cfn_sub", 0.55), ("shared", "cfn_import_value", 0.35), ("Table", "cfn_depends_on", 0.85)}
    assert next(r for r in b.refs if r["kind"] == "lambda_handler_file")["paths"][0] == "infra/src/app.py"
    assert {e["kind"] for e in b.edges} == {"routes_to_template_resource", "binds_handler", "lambda_event_source"}
    broken = resources.cloudformation("t.yaml", TEMPLATE + "  : : [\n")
    assert {n["name"] for n in broken.nodes} >= {"Table", "Fn"}
    c = resources.cmake("CMakeLists.txt", "add_library(core STATIC a.cpp b.cpp)\nadd_executable(app main.cpp)\n")
    assert [(n["kind"], n["name"]) for n in c.nodes] == [("cmake_library", "core"), ("cmake_executable", "app")] and json.loads(c.nodes[0]["metadata"])["sources"] == ["STATIC", "a.cpp", "b.cpp"]
    assert [n["kind"] for n in extract_one("x/part.cmake", "text", "add_library(core a.cpp)").nodes] == ["resource"]
    sln = resources.dotnet("a.sln", 'Project("{F}") = "App", "src\\App\\App.csproj", "{1}"\nEndProject\nProject("{2}") = "Folder", "Folder", "{3}"\nEndProject\n')
    assert [(n["name"], n["signature"]) for n in sln.nodes] == [("App", "src/App/App.csproj")]
    d = resources.dotnet("a/b.csproj", '<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><ProjectReference Include="..\\c\\c.csproj" /></ItemGroup></Project>')
    assert json.loads(d.nodes[0]["metadata"])["frameworks"] == ["net8.0"] and refs(d, "project_reference") == ["c.csproj"]


@pytest.fixture
def tree(tmp_path):
    for path, text in {"src/run.py": "from lib import helper\n\ndef run():\n    helper()\n", "src/lib.py": "def helper():\n    pass\n", "README.md": "# Hi\n", "node_modules/x.js": "x", "go.mod": "module m\n", "bad.py": "def (", "vendor/v.go": "package v"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(tmp_path)


def test_scan_extract_resolve(spark, tree):
    from lodestack.operators import graph as G

    raw = F_.read_tree(spark, tree)
    page = F_.scan(raw, max_files=3, priority_paths=["src/lib.py"])
    assert [r["path"] for r in page["files"].orderBy("position").collect()] == ["src/lib.py", "go.mod", "README.md"]
    total = page["totals"].first()
    assert total["truncated"] and total["continuation"] == "README.md"
    rest = F_.scan(raw, max_files=10, priority_paths=["src/lib.py"], after_path="README.md")
    assert [r["path"] for r in rest["files"].orderBy("position").collect()] == ["bad.py", "src/run.py"] and not rest["totals"].first()["truncated"]
    with pytest.raises(ValueError):
        F_.scan(raw, after_path="nowhere")
    assert {r["reason"]: r["samples"] for r in page["skipped"].collect()} == {"generated_or_vendor": ["node_modules/x.js", "vendor/v.go"]}
    every = F_.scan(raw)["files"].drop("position", "language")
    t = registry.tables(registry.extract(F_.identified(every)))
    assert [(r["path"], r["error"]) for r in t["errors"].collect()] == [("bad.py", "SyntaxError")]
    done = G.resolve_references(t["refs"], t["nodes"]).where("resolution = 'resolved'")
    targets = {r["node_id"]: r["name"] for r in t["nodes"].collect()}
    assert {(r["kind"], targets[r["target"]]) for r in done.collect()} == {("import", "helper"), ("call", "helper")}


def test_coverage(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, False)], "p string, e boolean, x boolean")
    c = F_.coverage(d, "graph", F.col("e"), F.lit(True), F.col("x"), False).first()
    assert (c["state"], c["eligible_files_seen"], c["extracted_files"], c["policy_excluded_files"]) == ("partial", 2, 1, 1)
