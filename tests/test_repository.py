"""Resolution, patterns, history, tool queries and task analysis on small repositories."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import fixed, paths
from tesserae.operators import briefing, configs, extract, graph, history, patterns, resolve, rules, timewin, tools, vote, windows
from tesserae.plans import scan
from tesserae.sources import repository


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(spark, **contents):
    return spark.createDataFrame([(k, v) for k, v in contents.items()], "path string, content string")


def tree(spark, *names, content=""):
    return spark.createDataFrame([(n, content) for n in names], "path string, content string")


def resolved(spark, how, known, *edges):
    e = spark.createDataFrame(list(edges), "src string, spec string")
    return {(r.src, r.spec): r.dst for r in how(e, tree(spark, *known)).collect()}


def test_script_resolution(spark):
    known = ["src/utils.ts", "src/lib/helpers.ts", "src/lib/api.ts", "src/types.ts", "src/comp/index.tsx", "src/plain.js"]
    got = resolved(spark, resolve.script, known, ("src/index.ts", "./utils"), ("src/deep/file.ts", "../lib/helpers"), ("a.ts", "@/lib/api"), ("src/x.ts", "./types.js"), ("src/x.ts", "./comp"), ("src/x.ts", "~/plain.js"), ("src/x.ts", "./missing"), ("a.ts", "./src/utils"))
    assert got == {("src/index.ts", "./utils"): "src/utils.ts", ("src/deep/file.ts", "../lib/helpers"): "src/lib/helpers.ts", ("a.ts", "@/lib/api"): "src/lib/api.ts", ("src/x.ts", "./types.js"): "src/types.ts",
                   ("src/x.ts", "./comp"): "src/comp/index.tsx", ("src/x.ts", "~/plain.js"): "src/plain.js", ("a.ts", "./src/utils"): "src/utils.ts"}


def test_python_resolution(spark):
    known = ["pkg/validators.py", "pkg/core/utils.py", "pkg/sub/__init__.py", "pkg/__init__.py", "lib/ansible/x.py", "top.py", "__init__.py"]
    got = resolved(spark, resolve.python, known, ("pkg/models.py", ".validators"), ("pkg/sub/a.py", "..core.utils"), ("pkg/models.py", ".sub"), ("pkg/models.py", "."), ("pkg/a.py", "ansible.x"), ("pkg/a.py", "os"), ("pkg/a.py", "top"), ("x.py", "..top"), ("x.py", "."))
    assert got == {("pkg/models.py", ".validators"): "pkg/validators.py", ("pkg/sub/a.py", "..core.utils"): "pkg/core/utils.py", ("pkg/models.py", ".sub"): "pkg/sub/__init__.py", ("pkg/models.py", "."): "pkg/__init__.py",
                   ("pkg/a.py", "ansible.x"): "lib/ansible/x.py", ("pkg/a.py", "top"): "top.py", ("x.py", "..top"): "top.py", ("x.py", "."): "__init__.py"}


def test_go_resolution(spark):
    known = ["main.go", "svc/core/core.go", "svc/core/a.go", "svc/db/b.go", "svc/db/a_test.go", "svc/db/deep/a.go"]
    e = spark.createDataFrame([("main.go", "ex.org/m/svc/core"), ("main.go", "ex.org/m/svc/db"), ("svc/db/b.go", "ex.org/m"), ("main.go", "fmt"), ("main.go", "ex.org/m/none")], "src string, spec string")
    assert {r.spec: r.dst for r in resolve.go(e, tree(spark, *known), "ex.org/m").collect()} == {"ex.org/m/svc/core": "svc/core/core.go", "ex.org/m/svc/db": "svc/db/b.go", "ex.org/m": "main.go"}


def test_rust_resolution(spark):
    known = ["crates/a/src/lib.rs", "crates/a/src/net/mod.rs", "crates/a/src/net/tcp.rs", "crates/a/src/util.rs", "main.rs", "x.rs"]
    got = resolved(spark, resolve.rust, known, ("crates/a/src/lib.rs", "mod::net"), ("crates/a/src/lib.rs", "mod::util"), ("crates/a/src/net/tcp.rs", "super::util"), ("crates/a/src/net/tcp.rs", "crate::util::f"),
                   ("crates/a/src/net/tcp.rs", "crate::net::tcp"), ("y.rs", "crate::x::f"), ("y.rs", "crate::none"), ("y.rs", "super"))
    assert got == {("crates/a/src/lib.rs", "mod::net"): "crates/a/src/net/mod.rs", ("crates/a/src/lib.rs", "mod::util"): "crates/a/src/util.rs", ("crates/a/src/net/tcp.rs", "super::util"): "crates/a/src/util.rs",
                   ("crates/a/src/net/tcp.rs", "crate::util::f"): "crates/a/src/util.rs", ("crates/a/src/net/tcp.rs", "crate::net::tcp"): "crates/a/src/net/mod.rs", ("y.rs", "crate::x::f"): "x.rs"}


@pytest.mark.parametrize(("family", "name", "content", "ending", "n"), [
    ("router", "Express routers", "const r = express.Router()", ".ts", 2), ("router", "tRPC routers", "export const r = createTRPCRouter({})", ".ts", 2), ("router", "Flask routes", "@app.route('/x')", ".py", 2),
    ("router", "FastAPI endpoints", "app = FastAPI()", ".py", 2), ("schema", "Zod", "z.object({})", ".ts", 3), ("schema", "Pydantic", "class A(BaseModel):", ".py", 3), ("auth", "auth hooks (useAuth/useSession/useUser)", "useSession()", ".tsx", 2),
    ("auth", "JWT (jsonwebtoken)", "jwt.verify(t)", ".js", 2), ("auth", "Django login_required", "@login_required", ".py", 2), ("database", "Prisma", "await prisma.user.find()", ".ts", 2), ("database", "Django ORM", "class A(models.Model):", ".py", 2),
    ("database", "SQLAlchemy", "from sqlalchemy import x", ".py", 2), ("style", "Tailwind CSS", '<a className="flex p-2">', ".tsx", 3), ("style", "CSS Modules", "import s from './a.module.css'", ".tsx", 3), ("state", "React Query/TanStack Query", "useQuery(k)", ".ts", 3),
    ("i18n", "useTranslation()", "const t = useTranslation()", ".tsx", 3),
])
def test_dominant_patterns(spark, family, name, content, ending, n):
    few = tree(spark, *(f"src/f{k}{ending}" for k in range(n - 1)), content=content)
    assert rows(patterns.dominant(few, family=family)) == []
    assert rows(patterns.dominant(few.union(tree(spark, f"src/more{ending}", content=content)), family=family)) == [(family, name, n)]


def test_patterns_are_scoped(spark):
    commented = tree(spark, *(f"src/f{k}.ts" for k in range(4)), content="// z.object({})\n/* prisma.user */")
    assert rows(patterns.dominant(commented)) == []
    assert rows(patterns.dominant(tree(spark, *(f"f{k}.go" for k in range(4)), content="express.Router()"), family="router")) == []
    assert rows(patterns.dominant(tree(spark, *(f"src/f{k}.test.ts" for k in range(4)), content="z.object({})"), family="schema")) == []
    assert rows(patterns.dominant(tree(spark, *(f"f{k}.ts" for k in range(4)), content="express.Router()"), mode="library", family="router")) == []
    bare = tree(spark, *(f"f{k}.ts" for k in range(3)), content="t('key')")
    assert rows(patterns.dominant(bare, family="i18n")) == [] and len(rows(patterns.dominant(bare.union(tree(spark, "locales/en.json")), family="i18n"))) == 1


def test_runners(spark):
    tests = tree(spark, "a.test.ts", "b.test.ts", content="describe('x', () => it('y'))")
    assert rows(patterns.dominant(tests, family="test")) == []
    assert rows(patterns.dominant(tests.union(tree(spark, "package.json", content='{"devDependencies": {"jest": "1", "vitest": "2"}}')), family="test")) == [("test", "Vitest", 2)]
    assert rows(patterns.dominant(tests.union(tree(spark, "deno.json")), family="test")) == [("test", "Deno test", 2)]
    py = tree(spark, "test_a.py", "test_b.py", content="def test_x(): pass")
    assert rows(patterns.dominant(py, family="test")) == []
    assert rows(patterns.dominant(py.union(tree(spark, *(f"pkg/m{k}.py" for k in range(5)))), family="test")) == [("test", "pytest", 2)]


def test_patterns_of_a_whole_tree(spark):
    """No family hinders another, even where a runner can't be told."""
    all_ = tree(spark, *(f"src/f{k}.test.ts" for k in range(3)), content="describe('x')").union(tree(spark, *(f"src/g{k}.ts" for k in range(3)), content="jwt.sign(x); prisma.user"))
    assert rows(patterns.dominant(all_)) == [("auth", "JWT (jsonwebtoken)", 3), ("database", "Prisma", 3)]


def test_labels(spark):
    d = spark.createDataFrame([(k, "Dominant patterns", x, "high") for k, x in enumerate(["API endpoints use A. Follow this pattern for new routes.", "API endpoints use B.", "Auth uses C.", "an auth integration", "Tests use D.", "nothing"])], "pos int, category string, description string, confidence string")
    assert rows(patterns.quick_reference(d)) == [("auth", "Auth uses C."), ("integrations", "an auth integration"), ("routing", "API endpoints use A")]
    assert len(rows(patterns.quick_reference(d, verbose=True))) == 4


def test_environment_and_aliases(spark):
    f = tree(spark, "a.ts", content="process.env.SECRET + process.env.NEXT_PUBLIC_A + import.meta.env.VITE_B + process.env.NODE_ENV + process.env.SECRET")
    assert rows(patterns.env_vars(f)) == [("NEXT_PUBLIC_A", "public"), ("NODE_ENV", "neither"), ("SECRET", "private"), ("VITE_B", "public")]
    assert rows(patterns.path_aliases(tree(spark, "tsconfig.json", "bad.json", content='{"compilerOptions": {"paths": {"@/*": ["src/*"], "~": ["x"]}}}').union(tree(spark, "x.json", content="{")))) == [("@",), ("~",)]
    assert [r[0] for r in tree(spark, "go.mod", content="// c\nmodule ex.org/m\n").union(tree(spark, "x", content="no")).select(patterns.go_module(F.col("content"))).collect()] == ["ex.org/m", None]


def test_history(spark):
    log = spark.createDataFrame([(str(k), f"2024-03-{k + 1:02} 10:00:00", s) for k, s in enumerate(['Revert "feat: a"', 'Revert "bump x"', 'Revert "feat: b"', "fix(core): c", "feat(ui): d", "docs: e", "wip", "Revert badly", "feat(ui): f"])], "commit_id string, ts string, subject string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(history.reverts(log)) == [(4, ["feat: b", "feat: a"])]
    assert rows(history.reverts(log.where("commit_id = '0'"))) == []
    assert rows(history.conventions(log)) == [] and rows(history.conventions(log.where("commit_id > '2' AND commit_id <> '7'"))) == [("core", 1, 0.8), ("ui", 2, 0.8)]
    gone = spark.createDataFrame([(c, s, "D", f"f{k}") for c, s, n in (("1", "drop all", 3), ("2", "chore(release): x", 4), ("3", "drop two", 2), ("4", "drop more", 5)) for k in range(n)], "commit_id string, subject string, status string, path string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert rows(history.deleted_batches(gone)) == [("1", 3), ("4", 5)]
    assert history.enough(log, shallow=False) and not history.enough(log, shallow=True) and history.enough(log, True, least=9)
    changed = spark.createDataFrame([("a.ts", 0), ("b.md", 1), ("a.ts", 2), ("c.PY", 3)], "path string, idx int")
    assert rows(history.modified(changed)) == [("a.ts", 0), ("c.PY", 3)]


def test_kinds_of_files(spark):
    names = ["src/Tests/a.ts", "a.spec.ts", "x_test.py", "x_test.go", "spec/a.rb", "test.js", "src/contest.ts", "examples/a.ts", "exampleUse.js", "pages/a.ts", "next.config.js", "src/a.css"]
    got = tree(spark, *names).select("path", paths.is_test(F.col("path")), paths.is_test_for_tasks(F.col("path")), paths.is_example(F.col("path")), paths.is_entry_point(F.col("path")), paths.language(F.col("path")))
    assert {tuple(r) for r in got.collect()} == {
        ("src/Tests/a.ts", True, True, False, False, "TypeScript"), ("a.spec.ts", True, True, False, False, "TypeScript"), ("x_test.py", True, True, False, False, "Python"), ("x_test.go", False, True, False, False, "Go"),
        ("spec/a.rb", False, True, False, False, "Ruby"), ("test.js", True, False, False, False, "JavaScript"), ("src/contest.ts", False, False, False, False, "TypeScript"), ("examples/a.ts", False, False, True, False, "TypeScript"),
        ("exampleUse.js", False, False, True, False, "JavaScript"), ("pages/a.ts", False, False, False, True, "TypeScript"), ("next.config.js", False, False, False, True, "JavaScript"), ("src/a.css", False, False, False, False, "CSS"),
    }


def test_tool_queries(spark):
    edges = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h"), ("d", "h"), ("h", "z"), ("z", "h")], "src string, dst string")
    ranks = spark.createDataFrame([("h", 0.5), ("z", 0.2), ("a", 0.1)], "node string, score double")
    hubs = graph.hubs(edges)
    f = spark.createDataFrame([(1, "Fragile code", "h breaks", "high", ["h"]), (2, "Testing", "plain", "low", []), (3, "Naming pattern", "z.", "medium", ["q"])], "id int, category string, description string, confidence string, evidence array<string>")
    tied = tools.finding_files(f, spark.createDataFrame([("h",), ("z",)], "path string"))
    assert rows(tied) == [(1, "h"), (3, "z")]
    assert rows(tools.file_contexts(ranks, hubs, edges, tied)) == [("a", 0.1, 0, 1, False, 0), ("h", 0.5, 5, 1, True, 1), ("z", 0.2, 1, 1, False, 1)]
    assert [r.id for r in tools.conventions(f).orderBy("id").collect()] == [2, 3] and [r.id for r in tools.conventions(f, "NAMING").collect()] == [3] and [r.id for r in tools.history(f).collect()] == [1]
    assert rows(tools.import_graph(edges, 1)) == [("h", 5, 1)]
    assert rows(tools.change_radius(spark.createDataFrame([("h",), ("z",), ("q",)], "item string"), ranks, edges, hubs)) == [("h", 1, 5, True), ("z", 2, 1, False)]
    assert rows(tools.cycle_hubs(graph.cycles(edges), hubs)) == [("h>z",)]
    assert rows(tools.gated_orphans(ranks.select("node"))) == [("a",), ("h",), ("z",)] and rows(tools.gated_orphans(ranks.select("node").limit(2))) == []
    assert rows(tools.map_nodes(edges, spark.createDataFrame([("q",)], "node string"), spark.createDataFrame([("a", "b")], "a string, b string"), ranks)) == [("a", 0, False, 0.1), ("b", 0, False, None), ("h", 6, False, 0.5), ("q", 0, True, None)]
    layout = tools.map_layout(spark.createDataFrame([("h", 6, 0.5), ("a", 0, 0.1), ("b", 0, None)], "node string, edges long, score double"))
    assert {r.node: r.ring for r in layout.collect()} == {"h": 0, "a": 1, "b": 1} and abs(sum(r.x for r in layout.collect())) < 1e-5
    assert rows(tools.by_category(f)) == [("Fragile code", 1, 1, 1), ("Naming pattern", 3, 1, 0), ("Testing", 2, 1, 0)]
    runs = spark.createDataFrame([(False, 0.0), (True, 0.0), (True, 0.5), (True, 1.0)], "produced_patch boolean, recall double")
    assert rows(tools.failures(runs)) == [("COMPLETE", 1), ("NO PATCH", 1), ("PARTIAL", 1), ("WRONG FILES", 1)]
    line = f.select(tools.why(F.col("description"), F.col("evidence"), F.col("confidence"))).collect()
    assert [r[0] for r in line] == ["h breaks; found in 1 files; high confidence", "plain; low confidence", "z.; found in 1 files; medium confidence"]
    assert [r.id for r in f.orderBy(*tools.order(f)).collect()] == [1, 3, 2]


def test_gates(spark):
    few = spark.createDataFrame([(f"a{k}.ts", "TypeScript") for k in range(4)] + [("x.go", "Go")], "path string, language string")
    none = spark.createDataFrame([], "src string, dst string")
    assert rows(tools.graph_gates(few, none)) == [("Go", 1, 0, "none"), ("TypeScript", 4, 0, "edges only")]
    assert rows(tools.graph_gates(few.limit(4), none)) == [("TypeScript", 4, 0, "none")]
    edges = spark.createDataFrame([("a0.ts", f"a{k}.ts") for k in range(4)] + [("a1.ts", "a0.ts")], "src string, dst string")
    assert ("TypeScript", 4, 5, "ranked") in rows(tools.graph_gates(few, edges))


def test_questions(spark):
    q = spark.createDataFrame([(1, "How does login work?"), (2, "Tell me about authentication errors"), (3, "zebra crossing")], "k int, text string")
    got = tools.asked(q, "text")
    assert {(r.k, r.topic, r.points) for r in got.collect()} >= {(1, "auth", 2), (2, "errors", 3)} and not got.where("k = 3").collect()
    f = spark.createDataFrame([(1, "Dominant patterns", "login by hooks", "high"), (2, "Dominant patterns", "other", "high"), (3, "Error handling", "x", "low"), (4, "Style", "zebra stripes", "low")], "id int, category string, description string, confidence string")
    assert rows(tools.answers(got.where("k = 1"), f, "k", "text")) == [(1, 1, "high")]
    assert (2, 3, "low") in rows(tools.answers(got.where("k = 2"), f, "k", "text"))
    assert rows(tools.fallback(q.where("k = 3"), f, "k", "text")) == [(3, 4, "low")]


def test_analysis_of_a_task(spark):
    names = ["src/core/login.ts", "src/core/store.ts", "src/ui/loginForm.ts", "src/app.ts", "deep/galaxy/collection/user_guide.py", "far/x.ts"]
    edges = spark.createDataFrame([("src/core/login.ts", "src/core/store.ts"), ("src/app.ts", "src/core/login.ts"), ("src/core/store.ts", "far/x.ts")], "src string, dst string")
    partners = spark.createDataFrame([("src/core/login.ts", "src/ui/loginForm.ts", 0.7)], "item string, partner string, strength double")
    tasks = spark.createDataFrame([(1, "Mend src/core/login.ts and the user guide"), (2, "nothing")], "task int, text string")
    got = {r.companion: (r.score, r.signals, r.rank) for r in tools.analyse(tasks, tree(spark, *names), edges, partners).collect()}
    assert got == {"src/core/store.ts": (0.5, "linked sibling,imports", 1), "src/ui/loginForm.ts": (0.42, "co-change", 2), "deep/galaxy/collection/user_guide.py": (0.35, "keyword", 3)}


def test_tasks_weigh_importers_imports_and_neighbours(spark):
    """Points add up over named files; tests never come in; relevance, markers and modules decide the weights."""
    names = ["lib/galaxy/api/proxy.py", "lib/galaxy/api/__init__.py", "lib/galaxy/api/token.py", "lib/galaxy/api/test_proxy.py", "lib/galaxy/other.py", "lib/net/http.py", "lib/net/pool.py", "web/page.py", "lib/galaxy/collection/meta.py"]
    e = [("lib/galaxy/api/proxy.py", "lib/net/http.py"), ("lib/galaxy/api/proxy.py", "lib/galaxy/api/__init__.py"), ("lib/galaxy/api/__init__.py", "lib/galaxy/api/token.py"), ("lib/net/http.py", "lib/net/pool.py"), ("web/page.py", "lib/galaxy/api/proxy.py"),
         ("lib/galaxy/api/test_proxy.py", "lib/galaxy/api/proxy.py"), ("lib/galaxy/api/proxy.py", "lib/galaxy/collection/meta.py"), ("lib/galaxy/other.py", "lib/galaxy/api/proxy.py")]
    edges = spark.createDataFrame(e + [(f"x{k}.py", "web/page.py") for k in range(5)], "src string, dst string")
    partners = spark.createDataFrame([("lib/galaxy/api/proxy.py", "lib/galaxy/api/test_proxy.py", 0.9)], "item string, partner string, strength double")
    tasks = spark.createDataFrame([(1, "Galaxy collection: mend lib/galaxy/api/proxy.py")], "task int, text string")
    got = {r.companion: (r.score, r.signals) for r in tools.analyse(tasks, tree(spark, *names), edges, partners, least=0.0, k=99).collect()}
    assert got == {
        "lib/galaxy/api/__init__.py": (0.4, "linked sibling,imports"), "lib/net/http.py": (0.2, "imports"), "lib/galaxy/collection/meta.py": (0.4, "imports"), "web/page.py": (0.25, "imported by"), "lib/galaxy/other.py": (0.15, "imported by"),
        "lib/galaxy/api/token.py": (0.1, "two steps"), "lib/net/pool.py": (0.1, "two steps"),
    }
    first = tools.analyse(tasks, tree(spark, *names), edges, partners).collect()
    assert [r.companion for r in sorted(first, key=lambda r: r.rank)] == ["lib/galaxy/collection/meta.py", "lib/galaxy/api/__init__.py", "web/page.py"], "what fits the task goes first among equals"


def test_what_a_facade_passes_on(spark):
    names = ["a/main.py", "b/__init__.py", "b/impl.py", "b/test_impl.py", "c/index.ts", "c/part.ts", "a/page.ts", "b/far.py"]
    e = [("a/main.py", "b/__init__.py"), ("b/__init__.py", "b/impl.py"), ("b/__init__.py", "b/test_impl.py"), ("b/__init__.py", "a/main.py"), ("a/page.ts", "c/index.ts"), ("c/index.ts", "c/part.ts"), ("b/impl.py", "b/far.py")]
    from tesserae.operators import changes, context

    none = spark.createDataFrame([], "item string, partner string, strength double")
    signals = context.file_signals(spark.createDataFrame([("a/main.py",), ("a/page.ts",)], "item string"), none, spark.createDataFrame(e, "src string, dst string"), tree(spark, *names))
    got = {(r.item, r.companion): (r.score, r.signals) for r in changes.companions(signals, least=0.0).collect()}
    assert got == {("a/main.py", "b/impl.py"): (0.3, "facade"), ("a/page.ts", "c/part.ts"): (0.3, "facade"), ("a/page.ts", "c/index.ts"): (0.25, "imports")}
    tests = spark.createDataFrame([("a/main.py", "b/test_impl.py", 0.9), ("a/main.py", "b/far.py", 0.5)], "item string, partner string, strength double")
    near = context.file_signals(spark.createDataFrame([("a/main.py",)], "item string"), tests, spark.createDataFrame([], "src string, dst string"), tree(spark, *names))
    assert {r.companion for r in changes.companions(near).collect()} == {"b/far.py"}


def test_names_that_extend_one_another(spark):
    """As a comparison of all names of a folder would find them, but by equality of prefixes."""
    from tesserae.operators import context

    stems = ["node", "node_plan", "nodePlan", "nodeplan", "node2", "node-x", "node_plan_instance", "nod", "nod_e", "Node", "plan", "node_", "üblich", "üblich_x"]
    names = [f"{d}/{s}.{x}" for d in ("a", "b/c") for s in stems for x in ("go", "ts")] + ["node.go", "node_top.go"]
    got = {(r.item, r.companion) for r in context.prefix_pairs(spark.createDataFrame([(n,) for n in names], "item string"), tree(spark, *names)).collect()}

    def fits(x, y):
        (dx, _, nx), (dy, _, ny) = x.rpartition("/"), y.rpartition("/")
        short, long = sorted((nx.rsplit(".", 1)[0], ny.rsplit(".", 1)[0]), key=len)
        after = long[len(short) : len(short) + 1]
        return x != y and dx == dy and len(short) >= 4 and long.startswith(short) and (after == "_" or after == after.upper())

    assert got == {(x, y) for x in names for y in names if fits(x, y)}
    plan = context.prefix_pairs(spark.createDataFrame([(n,) for n in names], "item string"), tree(spark, *names))._jdf.queryExecution().optimizedPlan().toString()
    assert all("stem" in line for line in plan.splitlines() if "Join" in line)


def test_questions_have_folders_and_confidence(spark):
    q = spark.createDataFrame([(1, "Where do route tests live?"), (2, "zebra"), (3, "how is auth done?"), (4, "zebra stripes")], "k int, text string")
    topics = tools.asked(q, "text")
    folders = spark.createDataFrame([("tests", "Tests"), ("api", "API routes or endpoints"), ("src", "Source code"), ("routes", None)], "dir string, purpose string")
    assert rows(tools.question_folders(topics, folders, "k")) == [(1, "api", "API routes or endpoints"), (1, "tests", "Tests")]
    f = spark.createDataFrame([(1, "Testing", "apart", "high"), (2, "Testing", "apart", "low"), (3, "Dominant patterns", "routes by x", "high"), (4, "Dominant patterns", "zebra", "low")], "id int, category string, description string, confidence string")
    found = tools.answers(topics, f, "k", "text")
    assert rows(found) == [(1, 1, "high"), (1, 3, "high")], "patterns answer by the keywords of topics; what says the same answers once"
    more = found.unionByName(tools.fallback(q.where("k = 4"), f, "k", "text"))
    assert rows(tools.answer_confidence(topics, more, q, "k")) == [(1, "high"), (2, "low"), (3, "low"), (4, "medium")]


def test_silent_signals(spark):
    names = ["svc/a.go", "svc/b.go", "svc/a_test.go", "pkg/__init__.py", "pkg/x.py", "pkg/y.py"]
    edges = spark.createDataFrame([("pkg/__init__.py", "pkg/x.py"), ("pkg/__init__.py", "pkg/y.py")], "src string, dst string")
    none = spark.createDataFrame([], "item string, partner string, strength double")
    from tesserae.operators import changes, context

    signals = context.file_signals(spark.createDataFrame([("svc/a.go",), ("pkg/x.py",)], "item string"), none, edges, tree(spark, *names))
    assert {(r.item, r.companion, r.score, r.signals) for r in changes.companions(signals).collect()} == {("svc/a.go", "svc/b.go", 0.35, "same folder"), ("pkg/x.py", "pkg/__init__.py", 0.4, "linked sibling")}


def test_stacks_and_commands(spark):
    py = tree(spark, *(f"pkg/m{k}.py" for k in range(5)), content="from fastapi import x")
    assert rows(rules.language_stack(py)) == [] and rows(rules.language_stack(py.union(tree(spark, "requirements.txt", content="FastAPI")))) == [("FastAPI",)]
    assert rows(rules.language_stack(py.limit(4).union(tree(spark, "requirements.txt", content="django")))) == []
    assert rows(rules.language_stack(tree(spark, "go.mod", content="require github.com/gin-gonic/gin"))) == [("Go + Gin",)] and rows(rules.language_stack(tree(spark, "go.mod"))) == [("Go",)]
    none = spark.createDataFrame([], "name string, command string")
    assert rows(rules.fallback_commands(tree(spark, "go.mod", "cmd/x/main.go"), none)) == [("build", "go build ./..."), ("dev", "go run ./cmd/x"), ("test", "go test ./...")]
    assert rows(rules.fallback_commands(tree(spark, "go.mod", "Makefile"), spark.createDataFrame([("test", "mine")], "name string, command string"))) == [("build", "make"), ("dev", "go run ."), ("test", "mine")]
    assert rows(rules.fallback_commands(tree(spark, "pyproject.toml", content="[tool.poetry.scripts]").union(tree(spark, "requirements.txt")), none)) == [("dev", "poetry run dev"), ("test", "poetry run pytest")]
    assert rows(rules.structure(tree(spark, "components/a.ts", "utils/b.ts", "apps/x/c.spec.ts"))) == [(True, "layer", "colocated")]
    assert rows(rules.entry_points(tree(spark, "src/index.ts", "src/x.ts", "server.ts"))) == [("server.ts",), ("src/index.ts",)]


def test_updates_keep_what_was_written_by_hand(spark):
    schema = "header string, body string, pos int"
    old = spark.createDataFrame([("", "intro", 0), ("Mine", "m", 1), ("Commands", "old", 2), ("Also mine", "a", 3)], schema)
    new = spark.createDataFrame([("Commands", "new", 0), ("What to Add Manually", "w", 1)], schema)
    assert [r.header for r in scan.update(new, old).orderBy("ord").collect()] == ["Commands", "Mine", "Also mine", "What to Add Manually"]
    assert [r.header for r in scan.update(new.limit(1), old).orderBy("ord").collect()] == ["Commands", "Mine", "Also mine"]
    assert rows(scan.difference(new, old, "body")) == [("+", "new", 1), ("+", "w", 1), ("-", "a", 1), ("-", "intro", 1), ("-", "m", 1), ("-", "old", 1)]


def test_running_sums(spark):
    df = spark.createDataFrame([(k, k % 7) for k in range(500)], "k int, v int").repartition(6)
    got = {r.k: r.s for r in windows.running(df, ["k"], F.col("v"), "s").collect()}
    assert got == {k: sum(j % 7 for j in range(k)) for k in range(500)}
    assert windows.running(df.limit(0), ["k"], F.col("v"), "s").collect() == []
    assert [r.k for r in vote.stride(df, "k", 10).collect()] == list(range(0, 500, 50))


def test_small_pieces(spark):
    listed = repository.listing(tree(spark, "src/a.ts", "src/x/b.ts", "src/x/c.ts", "top.md"))
    assert rows(listed) == [("src", "a.ts"), ("src", "x/")]
    safe = repository.inside(spark.createDataFrame([("a/b",), ("a/../b",), ("../x",), ("a/../../x",), ("/etc/x",), ("/r/a",)], "path string"), "/r")
    assert rows(safe) == [("/r/a",), ("a/../b",), ("a/b",)]
    t = spark.createDataFrame([("---\nk: v\n---\nbody\n---\nmore",), ("no matter",)], "t string")
    assert [r[0] for r in t.select(briefing.without_front_matter(F.col("t"))).collect()] == ["body\n---\nmore", "no matter"]
    c = spark.createDataFrame([("test", "pytest"), ("dev", "turbo dev"), ("x", None)], "name string, command string")
    assert rows(briefing.command_lines(c)) == [("dev", "- dev: `turbo dev`")] and len(rows(briefing.command_lines(c, verbose=True))) == 2
    assert len(fixed.PATTERNS) == 56 and len(fixed.TOPICS) == 16


def test_a_repository_end_to_end(spark):
    """Files to imports, edges, hubs, patterns and a ranking, as a scan runs them."""
    f = files(spark, **{f"src/m{k}.ts": f'import {{ a }} from "./hub";\nexport const x = z.object({{}})\n// m{k}' for k in range(6)}, **{"src/hub.ts": "export const a = 1", "src/hub.test.ts": 'import "./x"\nimport { a } from "./hub"'})
    got = scan.project(f, spark.createDataFrame([("1", None, 'Revert "a"')], "commit_id string, ts timestamp, subject string").limit(0), spark.createDataFrame([], "commit_id string, ts timestamp, subject string, status string, path string"))
    assert rows(got["hubs"]) == [("src/hub.ts", 6, 1)] and ("schema", "Zod", 6) in rows(got["patterns"]) and got["edges"].count() == 7
    assert got["ranks"].orderBy(F.desc("score")).first().node == "src/hub.ts" and rows(got["languages"]) == [("TypeScript", 8)]
    warned = scan.check(got, spark.createDataFrame([("src/hub.ts", 0)], "item string, idx int"))
    assert {(r.target, r.signal) for r in warned.collect()} >= {("src/hub.test.ts", "import"), ("src/m0.ts", "import")}
    assert extract.script_imports is not None


def test_a_scan_tells_its_findings(spark):
    """Configurations, contents, imports and history in one table; a shallow copy says so instead of telling history."""
    f = files(spark, **{f"src/m{k}.ts": f'import {{ a }} from "./hub";\nexport const x = z.object({{}})\n// m{k}' for k in range(8)}, **{"src/hub.ts": "export const a = 1", "tsconfig.json": '{"compilerOptions": {"strict": false}}', "package.json": '{"type": "module", "devDependencies": {"typescript": "5"}}'})
    log = [(str(k), k, 'Revert "feat: a"' if k < 3 else "fix(core): b") for k in range(1, 9)]
    commits = spark.createDataFrame(log, "commit_id string, k int, subject string").withColumn("ts", F.expr("make_timestamp(2024, 3, k, 10, 0, 0)")).drop("k")
    changed = commits.crossJoin(spark.createDataFrame([("M", "src/m0.ts"), ("M", "lib/far.ts"), ("M", "docs/a.md")], "status string, path string"))
    got = scan.project(f, commits, changed)
    found = {(r.stage, r.category, r.name): r for r in got["findings"].collect()}
    assert {("configuration", "TypeScript", "strict"), ("mode", "Project structure", "library"), ("contents", "Dominant patterns", "schema"), ("imports", "Core modules", "hubs"), ("history", "Git history", "reverts"), ("history", "Anti-patterns", "reverted feat: a"),
            ("history", "Fragile code", "src/m0.ts"), ("history", "Hidden dependencies", "lib/far.ts + src/m0.ts"), ("history", "Commit conventions", "scopes"), ("history", "Active development", "areas")} <= set(found)
    assert found["contents", "Dominant patterns", "schema"].confidence == "high" and not any(k[1:] == ("Fragile code", "docs/a.md") for k in found)
    assert rows(got["mode"]) == [("library",)] and {r.framework for r in got["frameworks"].collect()} == {"TypeScript"}
    few = scan.told(got, configs.facts(f.withColumn("_scan", F.lit(0)), ["_scan"]), "library", history.enough(commits, shallow=True)).where("stage = 'history'")
    assert [(r.category, r.name) for r in few.collect()] == [("Git history", "shallow")] and rules.tiers(few).collect() == []


def test_the_newest_commits_prune_partitions(spark, tmp_path):
    rows_ = spark.range(2000).selectExpr("id AS commit_id", "timestamp'2020-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts", "'M' AS status", "concat('src/f', id % 7, '.ts') AS path", "'s' AS subject")
    rows_.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition(1).write.partitionBy("month").parquet(f"{tmp_path}/log")
    table = spark.read.parquet(f"{tmp_path}/log")
    newest = timewin.newest(timewin.recent(table, "ts", 700), 40, parts=["month"])
    assert sorted(r.commit_id for r in newest.collect()) == list(range(1960, 2000))
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert rows(history.churn(table, commits=40, parts=["month"])) == rows(history.churn(table, commits=40))
    assert sum(r.n for r in history.churn(table, commits=40).collect()) == 40 and timewin.newest(table.limit(0), 5).collect() == []


def test_nested_go_modules(spark):
    """The longest module that begins a specifier at a slash owns it."""
    f = files(spark, **{"go.mod": "module ex.org/m", "a/x.go": "", "sub/go.mod": "// c\nmodule ex.org/m/sub\n", "sub/deep/deep.go": "", "sub/deep/a.go": "", "sub/y.go": "", "elsewhere/go.mod": "module ex.org/m/a/far", "elsewhere/z.go": "", "subway/w.go": "", "bad/go.mod": "nothing"})
    assert rows(resolve.go_modules(f)) == [("ex.org/m", ""), ("ex.org/m/a/far", "elsewhere"), ("ex.org/m/sub", "sub")]
    specs = [("a/x.go", s) for s in ("ex.org/m/sub/deep", "ex.org/m/sub", "ex.org/m/a", "ex.org/m/a/far", "ex.org/m/subway", "ex.org/mother/a", "fmt", "ex.org/m/none", "ex.org/m")]
    got = resolve.go(spark.createDataFrame(specs, "src string, spec string"), f, resolve.go_modules(f))
    assert {(r.spec, r.dst) for r in got.collect()} == {("ex.org/m/sub/deep", "sub/deep/deep.go"), ("ex.org/m/sub", "sub/y.go"), ("ex.org/m/a", "a/x.go"), ("ex.org/m/a/far", "elsewhere/z.go"), ("ex.org/m/subway", "subway/w.go")}


def test_anti_patterns_and_their_remainder(spark):
    subjects = ['Revert "feat: a"', 'Revert "bump x"', 'Revert "feat: b"', "fix: c", 'Revert "feat: d"', 'Revert "feat: e"', "Revert badly"]
    log = spark.createDataFrame([(k, s) for k, s in enumerate(subjects)], "commit_id int, subject string").withColumn("ts", F.expr("make_timestamp(2024, 3, commit_id + 1, 10, 0, 0)"))
    changed = log.where("commit_id >= 3").crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "path string")).withColumn("status", F.lit("D"))
    assert rows(history.anti_patterns(log, changed.limit(0))) == [("reverted", "feat: d", 1, "high"), ("reverted", "feat: e", 1, "high"), ("reverted", "others", 2, "medium")]
    assert rows(history.anti_patterns(log.where("commit_id < 3"), changed)) == [("deleted", "3", 3, "medium"), ("reverted", "feat: a", 1, "high"), ("reverted", "feat: b", 1, "high")]
    assert rows(history.anti_patterns(log.limit(0), changed.limit(0))) == []


def test_two_levels_of_a_folder(spark):
    names = ["src/a.ts", "src/z/b.ts", "src/z/c/d.ts", "src/.hidden/x.ts", "src/node_modules/m/i.js", "src/z/.env", "other/a.ts", "top.md"] + [f"big/f{k:02}.ts" for k in range(60)] + [f"wide/d{k:02}/f{j}.ts" for k in range(20) for j in range(4)]
    asked = spark.createDataFrame([("src",), ("src/z",), ("big",), ("wide",), ("none",)], "dir string")
    got = {}
    for r in repository.folder_tree(tree(spark, *names), asked).orderBy("dir", "pos").collect():
        got.setdefault(r.dir, []).append(r.line)
    assert got["src"] == ["a.ts", "z/", "  b.ts", "  c/"] and got["src/z"] == ["b.ts", "c/", "  d.ts"] and len(got["big"]) == 25 and len(got["wide"]) == 35 and got["wide"][:3] == ["d00/", "  f0.ts", "  f1.ts"] and "none" not in got


def test_questions_about_a_file(spark):
    f = [(1, "Core modules", "src/a.ts is a hub"), (2, "Circular dependencies", "a > b"), (3, "Fragile code", "other/x.ts"), (4, "Anti-patterns", "tried x"), (5, "Import conventions", "aliases"), (6, "Dominant patterns", "Zod"), (7, "Active development", "Most active: src, lib"), (8, "Style", "tabs")]
    found = spark.createDataFrame(f, "id int, category string, description string")
    matches = spark.createDataFrame([(1, "src/a.ts"), (2, "src/a.ts"), (2, "lib/b.ts"), (3, "other/x.ts")], "id int, path string")
    asked = spark.createDataFrame([("src/a.ts",), ("docs/c.md",)], "item string")
    got = {(r.item, r.priority): (r.n, r.example) for r in briefing.file_questions(asked, found, matches).collect()}
    assert got == {("src/a.ts", 1): (1, "src/a.ts is a hub"), ("src/a.ts", 2): (1, "a > b"), ("src/a.ts", 5): (1, "tried x"), ("src/a.ts", 6): (2, "aliases"), ("src/a.ts", 7): (1, "Most active: src, lib"), ("docs/c.md", 5): (1, "tried x"), ("docs/c.md", 6): (2, "aliases")}
    maps = spark.createDataFrame([({"a": None},), ({"a": None, "b": "x"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in maps.select(rules.has_commands(F.col("m"))).collect()] == [False, True, False, False]


def test_hubs_are_limited_by_the_number_of_sources(spark):
    edges = spark.createDataFrame([(f"s{k}", f"h{j:02}") for j in range(12) for k in range(5)], "src string, dst string")
    many = lambda n: spark.range(n).selectExpr("'f' || id AS path")
    assert [graph.hubs(edges, sources=many(n)).count() for n in (100, 101, 501)] == [5, 10, 12] and graph.hubs(edges).count() == 5


def test_findings_meet_files_without_pairs_of_them_shuffled(spark):
    """Files of one name that many findings say: each pair once, by blocks; and their counts without the pairs."""
    f = [(k, ["a/x.ts", "none.ts", None] if k % 3 else None, "see index.ts, a/x.ts and a/x.ts" if k % 2 else "x.ts, b/index.ts and top.ts") for k in range(40)]
    f += [(None, ["b/index.ts"], "index.ts"), (None, ["b/index.ts"], "index.ts b/index.ts"), (41, ["b/index.ts"], None), (1, [], "index.ts")]
    f = spark.createDataFrame(f, "id int, evidence array<string>, description string")
    paths = [f"d{k}/index.ts" for k in range(30)] + ["a/x.ts", "b/index.ts", "b/index.ts", "top.ts", "c/other.ts"]
    files = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    want = set()
    for r in f.collect():
        said = {w.rstrip(",") for w in (r.description or "").split()}
        want |= {(r.id, p) for p in set(paths) if p in (r.evidence or []) or p in said or p.split("/")[-1] in said}
    found = tools.finding_files(f, files, block=7)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r.node: r.findings for r in tools.finding_counts(f, files).collect()}
    assert counts == {p: sum(q == p for _, q in want) for p in {q for _, q in want}}
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert plan[0].startswith("Union") and "RepartitionByExpression" in str(plan)  # no aggregation over the pairs


def test_answers_are_counted_without_pairs(spark):
    q = spark.createDataFrame([(1, "red widget of 1"), (2, "the red widget, of 2"), (3, "red gear"), (3, "gear red"), (4, "nothing"), (5, None), (None, "widget")], "k int, text string")
    f = [(1, "c", "red widget"), (2, "red", "widget"), (3, "x", "gear"), (3, "x", "widget"), (4, None, "red"), (5, "other", None), (None, "red", "gear"), (6, "x", "red widget red")]
    f = spark.createDataFrame(f, "id int, category string, description string").withColumn("confidence", F.lit("high"))
    want = {r.k: r.n for r in tools.fallback(q, f.where("id IS NOT NULL"), "k", "text").groupBy("k").agg(F.countDistinct("id").alias("n")).collect()} | {None: 4}
    found = tools.fallback_counts(q, f, "k", "text")
    assert {r.k: r.n for r in found.collect()} == want and want[1] == 5 and want[3] == 5
    many = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.lit("red widget").alias("text"))
    pile = spark.range(3000).select("id", F.lit("red").alias("category"), F.lit("widget").alias("description"))
    met = tools.fallback_counts(many, pile, "k", "text")
    assert met.agg(F.min("n"), F.max("n"), F.count("k")).first() == (3000, 3000, 3000)
    assert tools.fallback_counts(many, pile.limit(0), "k", "text").count() == 0
