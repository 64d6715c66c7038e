import pytest
from pyspark.sql import functions as F

from lodestone.functions.globs import Policy
from lodestone.operators import extraction as E
from lodestone.operators import graph as G
from lodestone.operators import search as S
from lodestone.sources import collectors as C
from lodestone.sources import sinks
from lodestone.sources import workspace as W
from lodestone.storage import materialize

FILES = {
    "app/docs/contracts/example-contract.md": "---\nid: APP-CONTRACT-001\nstatus: draft\nowner:\n  team: t\nrelated_anchors:\n  - ExampleService\n  - Other.run\n---\n# Example application contract\nSee `ExampleService`, APP-KG-001.\n## Inputs\n",
    "app/docs/adrs/example-adr.md": "---\nid: ADR-001\nstatus: accepted\nrelated_contracts:\n  - APP-CONTRACT-001\n---\n# Example decision\n",
    "app/docs/known-gaps.md": "# Known gaps\nAPP-KG-001 is open.\n",
    "app/src/example.py": '"""Doc."""\n\n\nclass ExampleService:\n    pass\n\n\nclass _Hidden:\n    pass\n',
    "app/tests/test_example.py": "class TestExampleService:\n    pass\n",
    "app/src/main/java/OrderController.java": "package a;\n\npublic final class OrderController {\n}\n",
    "app/build/out.md": "# Built\n",
}


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("work space")
    for name, text in FILES.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return str(root)


def test_files_and_policy(spark, workspace):
    policy = Policy(ignore=("build/",))
    rows = {r.path: r for r in W.files(spark, workspace, "*.md", policy).collect()}
    assert set(rows) == {"docs/contracts/example-contract.md", "docs/adrs/example-adr.md", "docs/known-gaps.md"}
    assert {r.repo for r in rows.values()} == {"app"} and rows["docs/known-gaps.md"].content_hash.startswith("sha256:")


def test_document_records(spark, workspace):
    rows = {r.kind: r for r in W.document_records(W.files(spark, workspace, "*.md", Policy(ignore=("build/",)))).collect()}
    contract = rows["contract"]
    assert (contract.id, contract.title, contract.external_id, contract.weight, contract.trust_level) == ("doc:app:docs:contracts:example-contract", "Example application contract", "APP-CONTRACT-001", 80, "draft")
    assert contract.known_gap_ids == ["APP-KG-001"] and contract.related_anchors == ["ExampleService", "Other.run"] and contract.headings == ["Example application contract", "Inputs"]
    assert (rows["adr"].trust_level, rows["adr"].related_contracts, rows["known_gaps"].trust_level, rows["known_gaps"].domain) == ("accepted", ["APP-CONTRACT-001"], "known_risk", "known-gaps")


def test_anchor_records(spark, workspace):
    code = W.files(spark, workspace, "*.{py,java}")
    rows = {r.symbol: r for r in W.anchor_records(code).collect()}
    assert set(rows) == {"ExampleService", "TestExampleService", "OrderController"}
    assert (rows["ExampleService"].id, rows["ExampleService"].anchor_type, rows["ExampleService"].line_start, rows["ExampleService"].kind) == ("anchor:app:src/example.py#ExampleService", "service", 4, "code_anchor")
    assert (rows["TestExampleService"].kind, rows["OrderController"].anchor_type) == ("test_anchor", "controller")


def test_scores_of_the_fixture(spark):
    """Scores derived by hand from the formula."""
    docs = [
        ("contract", "docs/contracts/example-contract.md", "contract", "Example application contract", "APP-CONTRACT-001", None, ["app", "contract", "example-contract", "example", "application", "001", "draft", "team", "team@example.com", "exampleservice"], ["Example application contract", "Inputs"], ["APP-KG-001"], 80, "draft"),
        ("adr", "docs/adrs/example-adr.md", "adr", "Example architectural decision", "ADR-001", None, ["app", "adr", "example-adr", "example", "architectural", "decision", "contract"], ["Example architectural decision"], [], 68, "draft"),
        ("gaps", "docs/known-gaps.md", "known_gaps", "Known gaps", None, None, ["app", "known_gaps", "known-gaps", "known", "gaps"], ["Known gaps"], ["APP-KG-001"], 90, "known_risk"),
        ("code", "src/example.py", "code_anchor", "ExampleService (app)", None, "ExampleService", ["app", "code_anchor", "exampleservice", "service", "python"], [], [], 58, "implementation"),
        ("test", "tests/test_example.py", "test_anchor", "TestExampleService (app)", None, "TestExampleService", ["app", "code_anchor", "testexampleservice", "test", "py"], [], [], 58, "implementation"),
    ]
    schema = "id string, path string, kind string, title string, external_id string, symbol string, keywords array<string>, headings array<string>, known_gap_ids array<string>, weight int, trust_level string"
    rows = spark.createDataFrame(docs, schema).withColumns({"repo": F.lit("app"), "domain": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "anchor_type": F.lit(None).cast("string")})
    queries = spark.createDataFrame([("example application contract",), ("ExampleService",), ("",), (None,)], "query string")
    got = {}
    for r in S.search(rows, queries).orderBy("query", "hit_rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    assert got == {"example application contract": [("contract", 34), ("adr", 20), ("code", 13), ("test", 13)], "ExampleService": [("code", 100), ("contract", 17), ("test", 13)]}
    only = S.search(S.restricted(rows, kinds=["contract"]), queries).where("query like 'example%'").collect()
    assert [(r.id, r.score) for r in only] == [("contract", 28)]
    gap = S.explicit_queries(spark.createDataFrame([("app-kg-001 ",), ("",), (None,)], "g string"), "g", "gap")
    assert [(r.id, r.score) for r in S.search_parsed(rows, gap).orderBy("hit_rank").collect()] == [("contract", 75), ("gaps", 64)]
    symbol = S.explicit_queries(spark.createDataFrame([("ExampleService",)], "s string"), "s", "symbol")
    assert [(r.query, r.id, r.score) for r in S.search_parsed(S.restricted(rows, kinds=["code_anchor"]), symbol).collect()] == [("symbol ExampleService", "code", 89)]


def test_chunks_sinks_and_changes(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "d#0", "doc_id": "d", "text": "x"}\n\nbroken\n{"chunk_id": "d#1", "doc_id": "d"}\n')
    chunks = W.chunk_lines(spark, str(tmp_path / "c.jsonl"))
    assert sorted(r.chunk_id for r in chunks.collect()) == ["d#0", "d#1"]
    sinks.write_chunks(chunks, str(tmp_path / "out"))
    assert W.chunk_lines(spark, str(tmp_path / "out")).count() == 2
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, content_hash string")
    assert sorted(r.id for r in W.changed_since(now, spark.createDataFrame([("a", "1"), ("b", "9")], now.schema)).collect()) == ["b", "c"]
    manifest = spark.read.parquet("/root/testdata/sf0.001/manifest_docs.parquet")
    edges = G.edges(manifest)
    sinks.write_graph(G.nodes(manifest), edges, str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph/edges")).count() == edges.count()
    sinks.write_records(manifest, str(tmp_path / "records"))
    assert spark.read.parquet(str(tmp_path / "records")).count() == manifest.count()


def test_structural_edges(spark):
    text = '''import a.b.Order;
import static a.OrderController;
@RestController
@RequestMapping("/api/")
public class OrderController {
  private final OrderService service;
  @Autowired private OrderRepository rows;
  @GetMapping("/{id}") void a() {}
  @PostMapping(value = "new") void b() {}
}
'''
    rows = [("r", "A.java", text), ("r", "A.java", text), ("r", "B.java", "class B { }"), ("r", "C.java", None), ("r", "D.py", text), ("r", "E.java", '@RestController @RequestMapping("/x") class E {}')]
    got = G.structural_edges(spark.createDataFrame(rows, "repo string, path string, text string"))
    assert {(r.source, r.edge_type, r.target) for r in got.collect()} == {
        ("OrderController", "imports", "Order"), ("OrderController", "implements_route", "/api/{id}"), ("OrderController", "implements_route", "/api/new"),
        ("OrderController", "uses_service", "OrderService"), ("OrderController", "uses_repository", "OrderRepository"), ("E", "implements_route", "/x/"),
    }
    assert [r.services for r in G.services_of_controllers(got).collect()] == ["OrderService"]


OWNER = "owner:\n  team: team\n  service: app\n  domain: app\n  contact: team@example.com\n"
SMALL = {
    "app/docs/contracts/example-contract.md": "---\nid: APP-CONTRACT-001\ntitle: Example application contract\nstatus: draft\n" + OWNER + "related_anchors:\n  - ExampleService\n---\n\n# Example application contract\n\n## Responsibilities\n\n`ExampleService` greets.\n\n## Non-responsibilities\n\n- None.\n\n## Inputs\n\n- A name.\n\n## Outputs\n\n- A text.\n\n## Known gaps\n\n- APP-KG-001\n",
    "app/docs/adrs/example-adr.md": "---\nid: ADR-APP-001\ntitle: Example architectural decision\nstatus: proposed\n" + OWNER + "related_contracts:\n  - APP-CONTRACT-001\n---\n\n# Example architectural decision\n\n## Context\n\nWords.\n",
    "app/docs/known-gaps.md": "# Known gaps\n\n| Gap | State |\n| --- | --- |\n| APP-KG-001 | open |\n",
    "app/src/example.py": '"""Words."""\n\n\nclass ExampleService:\n    """More."""\n\n    def greet(self, name):\n        if not name:\n            raise ValueError\n        return name\n',
    "app/tests/test_example.py": '"""Words."""\n\nimport unittest\n\n\nclass TestExampleService(unittest.TestCase):\n' + "    x = 1\n" * 10,
    "app/README.md": "# Not taken\n", "app/docs/generated/x.md": "# Not taken\n",
}


def laid_out(root, texts):
    for name, text in texts.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return str(root)


def test_whole_workspace(spark, tmp_path):
    found = W.files(spark, laid_out(tmp_path, SMALL))
    records, chunks = materialize(W.workspace_records(found), "records"), materialize(W.workspace_chunks(found), "chunks")
    got = {r.id: r for r in W.workspace_links(records, chunks).collect()}
    shown = {i: (r.kind, r.title, r.weight, r.source_type, r.trust_level, r.known_gap_ids, r.line_start, r.line_end) for i, r in got.items()}
    contract, adr, gaps = "doc:app:docs:contracts:example-contract", "doc:app:docs:adrs:example-adr", "doc:app:docs:known-gaps"
    code, test = "anchor:app:src/example.py#ExampleService", "anchor:app:tests/test_example.py#TestExampleService"
    assert shown == {
        contract: ("contract", "Example application contract", 80, "contract", "draft", ["APP-KG-001"], None, None), adr: ("adr", "Example architectural decision", 68, "adr", "draft", [], None, None),
        gaps: ("known_gaps", "Known gaps", 90, "known_gap", "known_risk", ["APP-KG-001"], None, None), code: ("code_anchor", "ExampleService (app)", 58, "code_anchor", "implementation", [], 4, 10),
        test: ("test_anchor", "TestExampleService (app)", 58, "test_anchor", "implementation", [], 1, 16),
    }
    assert {i: r.keywords for i, r in got.items()} == {
        contract: ["app", "contract", "example-contract", "example", "application", "001", "draft", "team", "team@example.com", "exampleservice"],
        adr: ["app", "adr", "example-adr", "example", "architectural", "decision", "001", "proposed", "team", "team@example.com", "contract"],
        gaps: ["app", "known_gaps", "known-gaps", "known", "gaps"], code: ["app", "code_anchor", "exampleservice", "service", "python"], test: ["app", "code_anchor", "testexampleservice", "test", "py"],
    }
    assert got[contract].headings == ["Example application contract", "Responsibilities", "Non-responsibilities", "Inputs", "Outputs", "Known gaps"]
    assert {r.doc_id: r["count"] for r in chunks.groupBy("doc_id").count().collect()} == {contract: 6, adr: 1, gaps: 1, code: 1, test: 1}
    assert got[contract].code_anchors == [code] and got[code].related_doc_ids == [contract] and sum(r.unresolved for r in got.values()) == 0
    queries = spark.createDataFrame([("example application contract",), ("ExampleService",)], "query string")
    hits = {}
    for r in S.search(S.records(records), queries).orderBy("query", "hit_rank").collect():
        hits.setdefault(r.query, []).append((r.id, r.score))
    assert hits == {"example application contract": [(contract, 34), (adr, 20), (code, 13), (test, 13)], "ExampleService": [(code, 100), (contract, 17), (test, 13)]}


def test_denied_files_are_not_opened(spark, tmp_path):
    root = laid_out(tmp_path, SMALL | {f"app/src/legacy/f{i}.py": "x = 1\n" for i in range(40)})
    plan = W.files(spark, root, "*", Policy(mode="allowlist", include=("src/**",), exclude=("**/legacy/**",)))
    assert [r.path for r in plan.collect()] == ["src/example.py"]
    assert plan.rdd.getNumPartitions() == 1 and len(plan.inputFiles()) >= 1
    metrics = plan._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    plan._jdf.queryExecution().executedPlan().executeCollect()
    assert metrics.apply("numFiles").value() == 1


CODE = {
    "r/src/main/java/a/service/OrderService.java": "package a;\n\n@X\npublic class OrderService {\n  static class inner {}\n}\n", "r/src/main/java/a/OrderServiceImpl.java": "class OrderServiceImpl {}\n",
    "r/src/main/java/a/Plain.java": "class Plain {}\n", "r/src/main/java/a/target/XService.java": "class XService {}\n", "r/src/test/java/a/OrderServiceTest.java": "class OrderServiceTest {}\n",
    "r/server/src/api/userRouter.ts": "export const userRouter = 1;\nexport type Shape = {};\n", "r/src/mail/index.ts": "import './x';\n", "r/src/mail/deep/index.ts": "export const no = 1;\n", "r/tests/src/AService.ts": "export class AService {}\n",
    "r/src/views/UserView.vue": "<template/>\n", "r/src/views/lower.vue": "<template/>\n", "r/internal/x/job.go": "package x\n\ntype Job struct {\n}\n\nfunc Run(a int) {}\nfunc hidden(a int) {}\n", "r/internal/sdk/s.go": "type S struct {}\n", "r/cmd/a_test.go": "func TestA(t T) {}\n",
    "r/src/main/resources/application.yml": "server:\n  port: 1\nother:\n  x: 1\napi:\n  y: 2\n", "q/src/main/resources/application.yaml": "name: x\n", "r/openapi.yaml": "openapi: 3\n" * 2000, "r/x/openapi.yaml": "no\n",
    "r/docs/big.md": "| **pay** | takes money |\n", "r/src/long.py": "class Long:\n" + "    x = 1\n" * 2000, "r/tests/test_none.py": "x = 1\n",
}


def test_collectors_and_anchors(spark, tmp_path):
    found = W.files(spark, laid_out(tmp_path, CODE))
    rows = {(r.path.rsplit("/", 1)[-1], r.symbol): (r.anchor_type, r.language, r.line_start, r.line_end) for r in W.code_anchors(found).collect()}
    assert rows == {
        ("OrderService.java", "OrderService"): ("service", "java", 4, 6), ("OrderService.java", "inner"): ("java_type", "java", 5, 6), ("OrderServiceImpl.java", "OrderServiceImpl"): ("service_impl", "java", 1, 1),
        ("OrderServiceTest.java", "OrderServiceTest"): ("test", "java", 1, 1), ("userRouter.ts", "userRouter"): ("ts_router", "typescript", 1, 2), ("userRouter.ts", "Shape"): ("ts_type", "typescript", 1, 2),
        ("index.ts", "index"): ("ts_service", "typescript", 1, 1), ("UserView.vue", "UserView"): ("vue_component", "vue", 1, 1), ("job.go", "Job"): ("go_type", "go", 3, 7), ("job.go", "Run"): ("go_func", "go", 6, 7),
        ("a_test.go", "TestA"): ("test", "go", 1, 1), ("application.yml", "application-server"): ("yaml_block", "yaml", None, None), ("application.yml", "application-api"): ("yaml_block", "yaml", None, None),
        ("application.yaml", "application"): ("config", "yaml", 1, 1), ("long.py", "Long"): ("python_type", "python", 1, 819), ("test_none.py", "test_none"): ("test", "py", 1, 1), ("AService.ts", "AService"): ("test", "ts", 1, 1),
    }
    blocks = {r.symbol: r.excerpt for r in W.code_anchors(found).where("anchor_type = 'yaml_block'").collect()}
    assert blocks == {"application-server": "server:\n  port: 1", "application-api": "api:\n  y: 2\n"}
    spec = W.openapi_records(found).collect()
    assert [(r.path, r.kind, r.weight, r.trust_level) for r in spec] == [("openapi.yaml", "openapi_spec", 50, "inferred")]
    assert [len(r.text) for r in W.workspace_chunks(found).where("heading = 'openapi.yaml'").collect()] == [8192]
    assert [tuple(r) for r in C.repo_roles(found).collect()] == [("pay", "takes money")]
    paths = spark.createDataFrame([("apps/pay/x",), ("apps/pay-two/x",), ("z",), ("/apps/pay",)], "p string")
    assert [r[0] for r in paths.select(C.repo_of(F.col("p"), {"all": ".", "apps": "apps", "pay": "apps/pay"})).collect()] == ["pay", "apps", "all", "pay"]


def test_links_against_files(spark):
    links = [("r", "docs/a.md", t) for t in ("b.md#x", "../src/x.py", "sub", "/docs/b.md", "../../q/a.md", "../../gone/a.md", "no.md", "https://x", "#y", "b%20c.md")]
    files = spark.createDataFrame([("r", "docs/a.md"), ("r", "docs/b.md"), ("r", "docs/b c.md"), ("r", "docs/sub/z.md"), ("r", "src/x.py"), ("q", "a.md")], "repo string, path string")
    got = {r.target: r.link_class for r in E.resolved_links(spark.createDataFrame(links, "repo string, path string, target string"), files).collect()}
    assert got == {"b.md#x": "ok", "../src/x.py": "ok", "sub": "ok", "/docs/b.md": "ok", "../../q/a.md": "ok", "../../gone/a.md": "repo_not_there", "no.md": "target_not_found", "https://x": "skip_external", "#y": "skip_anchor", "b%20c.md": "ok"}


def test_text_sinks(spark, tmp_path):
    findings = spark.createDataFrame([("unresolved", "a\n b"), (None, None)], "drift_type string, summary string")
    sinks.write_lines(sinks.drift_lines(findings), str(tmp_path / "drift"), "# Drift")
    assert [r.value for r in spark.read.text(str(tmp_path / "drift")).collect()] == ["# Drift", "- **finding**: ", "- **unresolved**: a b"]
    assert sinks.drift_lines(findings.limit(0)).count() == 0
    status = spark.createDataFrame([("r", 1, 2, 3, 0, 1.5, True)], "repo string, records int, code_anchors int, test_anchors int, without_chunks int, age_hours double, rebuild boolean")
    assert [r.value for r in sinks.health_lines(status).collect()] == ["| r | 1 | 2 | 3 | 0 | 1.5 | true |"]
    sinks.write_suggestions(spark.createDataFrame([("r", "A", "x,y")], "repo string, source string, services string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().services == ["x", "y"]
