import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.functions.rulebook import RULES
from lintlake.operators import review, rules, structure

CASES = [  # rule, language, code that it flags, code that it passes
    ("PY001", "python", "try:\n  x()\nexcept:\n  pass", "try:\n  x()\nexcept ValueError:\n  pass"),
    ("PY002", "python", "def f(a=[]):\n  pass", "def f(a=None):\n  pass"),
    ("PY003", "python", "x = eval(y)", "# eval(y)"),
    ("PY004", "python", "password = 'hunter2hunter2'", "password = os.environ['x_long_enough']"),
    ("PY005", "python", "cursor.execute('SELECT * FROM t WHERE a = %s' % a)", "x = 'SELECT one'"),
    ("PY009", "python", "def public(a):\n  pass", "def public(a) -> int:\n  pass"),
    ("PY010", "python", "pickle.loads(x)", "yaml.load(x, Loader=yaml.SafeLoader)"),
    ("PY011", "python", "os.system('ls ' + name)", "os.system('ls')"),
    ("PY011", "python", "subprocess.run(f'ls {x}',\n  shell=True)", "subprocess.run(['ls', x])"),
    ("PY012", "python", "token = random.randint(1, 9)", "roll = random.randint(1, 9)"),
    ("PY013", "python", "minidom.parse(f)", "from defusedxml import minidom\nminidom.parse(f)"),
    ("PY014", "python", "u = request.args['u']\nrequests.get(u)", "requests.get(FIXED)"),
    ("JS001", "javascript", "var a = 1", "// var a = 1"),
    ("JS003", "javascript", "el.innerHTML = x", "el.innerHTML += x"),
    ("JS005", "javascript", "jwt.decode(t)", "jwt.decode(t)\njwt.verify(t, k, {algorithms: ['RS256']})"),
    ("JS006", "javascript", "target[k] = source[k]", "if (k === '__proto__') return\ntarget[k] = source[k]"),
    ("TS001", "typescript", "let a: any", "let a: string"),
    ("TS002", "typescript", "a!.b\nc!.d\ne!.f", "a!.b\nc!.d"),
    ("GO001", "go", "f, _ := os.Open(p)", "f, err := os.Open(p)"),
    ("GO002", "go", "package a\npanic(1)", "package main\nfunc main() {\npanic(1)\n}"),
    ("GO005", "go", "mu.Lock()\nx = 1", "mu.Lock()\ndefer mu.Unlock()"),
    ("GO006", "go", "func F(a int, ctx context.Context) {", "func F(ctx context.Context, a int) {"),
    ("GO007", "go", 'h := "10.1.1.1"', 'h := "127.0.0.1"'),
    ("GO008", "go", "c := make(chan int)\nc <- 1", "c := make(chan int)\ngo run(c)\nc <- 1"),
    ("JA003", "java", "Reader r = new FileReader(f);", "try (Reader r = new FileReader(f)) {"),
    ("JA004", "java", "catch (Exception e) {", "catch (IOException e) {"),
    ("RS001", "rust", "x.unwrap()", "#[test]\nfn t() { x.unwrap() }"),
    ("RS001", "rust", "#[test]\nfn t() {\n}\nx.unwrap()", "// x.unwrap()"),
    ("RS004", "rust", "a.clone()\n" * 5, "a.clone()\n" * 4),
    ("PERF001", "python", "for a in b:\n    re.compile(a)", "for a in b:\n    c(a)\nre.compile(a)"),
    ("PERF001", "javascript", "while (x) {\n  new RegExp(x)\n}", "new RegExp(x)"),
    ("PERF002", "python", "for a in b:\n  s += 'x'", "s += 'x'\nfor a in b:\n  pass"),
    ("PERF003", "python", "hashlib.md5(x)", "m = md5sum"),
    ("PERF004", "python", "p = sys.argv[1]\nopen(p)", "open('fixed')"),
    ("PERF005", "python", "print(password)", "print(total)"),
    ("CL001", "go", "// todo: fix", "todo()"),
    ("CL002", "java", "\n" * 500, "\n" * 499),
    ("CL003", "python", "f(7777)", "f(8080)"),
    ("CL003", "python", "f(123456789012)", "timeout(777)"),
    ("CL004", "rust", "token: 'abcdefgh'", "token: 'short'"),
]


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(2 * i + k, language, (bad, good)[k]) for i, (_, language, bad, good) in enumerate(CASES) for k in (0, 1)]
    files = spark.createDataFrame(rows, "file_id bigint, language string, code string")
    return {(r["file_id"], r["rule_id"]) for r in rules.raw_findings(files).select("file_id", "rule_id").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_each_rule_flags_and_passes(hits, i):
    assert (2 * i, CASES[i][0]) in hits
    assert (2 * i + 1, CASES[i][0]) not in hits


def test_ids_and_counts():
    assert len({r.id for r in RULES}) == 50
    assert len({r.key for r in RULES}) == len(RULES)


def test_structural_rules(spark):
    deep = "def f(a):\n" + "".join("    " * (d + 1) + "if a:\n" for d in range(8)) + "    " * 9 + "pass\n"
    long = "def g():\n" + "    x = 1\n" * 60
    files = spark.createDataFrame([(1, "python", deep), (2, "python", long), (3, "python", "if a and b:\n    pass\n" * 8)], "file_id bigint, language string, code string")
    got = {(r["file_id"], r["rule_id"]) for r in rules.raw_findings(structure.with_structure(files)).collect()}
    assert (1, "PY008") in got and (2, "PY007") in got and (3, "PY006") in got
    assert (2, "PY008") not in got


def test_null_and_unknown_files_have_no_findings(spark):
    files = spark.createDataFrame([(1, "python", None), (2, None, "eval(x)"), (3, "cobol", "eval(x)"), (4, "python", "")], "file_id bigint, language string, code string")
    assert rules.findings(files).count() == 0


def test_dedup_keeps_the_most_confident_and_is_idempotent(spark):
    files = spark.createDataFrame([(1, "python", "password = 'hunter2hunter2'\nx = 1")], "file_id bigint, language string, code string")
    once = rules.findings(files)
    security = [r for r in once.collect() if r["category"] == "security"]
    assert [r["rule_id"] for r in security] == ["PY004"]  # CL004 is as confident and comes later
    assert sorted(map(str, rules.dedup(once).collect())) == sorted(map(str, once.collect()))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["critical", "high", "medium", "low", "info"]), max_size=12))
def test_scores_stay_in_range(spark, severities):
    files = spark.createDataFrame([(1, "go")], "file_id bigint, language string")
    found = spark.createDataFrame([(1, s) for s in severities], "file_id bigint, severity string")
    row = review.file_scores(files, found).first()
    assert row["score"] == max(0, 100 - sum(review.PENALTY[s] for s in severities))
    assert row["n_findings"] == len(severities)


def test_blank_lines_shift_findings(spark):
    code = "x = eval(y)\nos.system('a' + b)\n"
    files = spark.createDataFrame([(k, "python", "\n" * k + code) for k in range(3)], "file_id bigint, language string, code string")
    rows = {(r["file_id"], r["rule_id"], r["line_start"]) for r in rules.findings(files).collect()}
    assert all((k, rule, line + k) in rows for k in range(3) for f, rule, line in rows if f == 0)


def test_disabled_rules(spark):
    files = spark.createDataFrame([(1, "python", "x = eval(y)")], "file_id bigint, language string, code string")
    assert "PY003" not in {r["rule_id"] for r in rules.findings(files, disabled=("PY003",)).collect()}
