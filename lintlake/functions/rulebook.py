"""The rules: what each looks for, in which languages, and how it is reported.

A rule is data: predicates of `lintlake.functions.predicates` and a few words.  `lintlake.operators.rules` compiles all
rules of a language into one projection over the lines of a file, and the line rules into SQL for comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lintlake.functions.predicates import FirstNotIn, Has, Re, Starts, Test, any_of, any_re

PY, JS, TS, GO, RS, JA = "python", "javascript", "typescript", "go", "rust", "java"
ALL = (PY, JS, TS, GO, RS, JA)
HASH, SLASH, STAR = "#", "//", "*"


@dataclass(frozen=True)
class Rule:
    """One rule.  kind: how `test` is used; see lintlake.operators.rules.

    key is unique, id the public one.  skip: prefixes of stripped lines that are passed over.  extract: pattern and
    group whose match fills {} in the title.  check: of kind "function", a function of (code, language) that gives
    (line or None, title or None, severity or None) for each finding, None standing for the rule's own.
    """

    key: str
    languages: tuple[str, ...]
    severity: str
    category: str
    confidence: float
    title: str
    test: Test | None = None
    skip: tuple[str, ...] = ()
    extract: tuple[str, int] | None = None
    kind: str = "line"
    least: int = 0
    check: Callable[[str, str], list[tuple[int | None, str | None, str | None]]] | None = None

    @property
    def id(self) -> str:
        found = re.match(r"[A-Z]+\d{3}", self.key)
        return found[0] if found else self.key


# --- Fixed values: the patterns, titles, severities and confidences that findings are compared by. ---

_PY004 = [
    r"(?i)(password|passwd|pwd|secret|api_key|apikey|token|auth_token|access_token)\s*=\s*[\"'][^\"']{8,}[\"']",
    r"(?i)(aws_access_key_id|aws_secret_access_key)\s*=\s*[\"'][^\"']+[\"']",
    r"sk-[a-zA-Z0-9]{20,}",
    r"ghp_[a-zA-Z0-9]{36}",
]
_INTERPOLATION = r"[\"'].*\{|f[\"']|%\s*[a-zA-Z(]|\+\s*[a-zA-Z_]"
_PY_INPUT = r"(?i)(request\.(args|form|json|data|get_json|cookies|headers|values|params)|input\s*\(|sys\.argv|os\.environ|getenv|flask\.request|form\[|params\[|body\[)"
_HTTP_CALL = r"\b(requests\.(get|post|put|delete|patch|head|request)|urllib\.request\.urlopen|httpx\.(get|post|put|delete|patch|AsyncClient)|aiohttp\.ClientSession\(\))\s*\("
_MUST_CHECK = r"\b(os\.(Open|Create|Remove|Rename|Mkdir|MkdirAll|Stat|Chmod|Chown)|io\.Copy|io\.ReadAll|io\.WriteString|json\.(Unmarshal|Marshal|Decode|Encode)|http\.(Get|Post|PostForm|NewRequest)|db\.(Query|Exec|QueryRow|Begin|Prepare)|rows\.(Scan|Next|Err)|tx\.(Commit|Rollback)|fmt\.(Fprintf|Fprintln|Fprint))\s*\("
_GO_SYNC = r"\bwg\.(Add|Done|Wait)\b|\bsync\.WaitGroup\b|<-\s*(ctx\.Done|done|quit|stop|cancel)|\bcontext\.WithCancel\b|errgroup\."
_PROTO_GUARD = r"===\s*['\"]__proto__['\"]|===\s*['\"]constructor['\"]|===\s*['\"]prototype['\"]|if\s*\([^)]*(__proto__|constructor)[^)]*\)|Object\.hasOwn\(|hasOwnProperty\s*\("
_RAW_TYPES = r"\b(List|Map|Set|Collection|Iterable|Iterator|Optional|Comparator|ArrayList|HashMap|HashSet|LinkedList|TreeMap|TreeSet)\s+\w+\s*[=;(,]"
_RESOURCES = r"\bnew\s+(FileInputStream|FileOutputStream|FileReader|FileWriter|BufferedReader|BufferedWriter|InputStreamReader|OutputStreamWriter|PrintWriter|Scanner|Connection|PreparedStatement|Statement|ResultSet|Socket|ServerSocket|ZipFile|JarFile)\s*\("
_WEAK_HASH = [
    r"\b(md5|MD5)\b",
    r"\bhashlib\.new\s*\(\s*[\"']md5[\"']",
    r"\bhashlib\.new\s*\(\s*[\"']sha1[\"']",
    r"\bhashlib\.md5\s*\(",
    r"\bhashlib\.sha1\s*\(",
    r"\bMessageDigest\.getInstance\s*\(\s*\"(MD5|SHA-1|SHA1)\"",
    r"\bcrypto\.createHash\s*\(\s*['\"]md5['\"]",
    r"\bcrypto\.createHash\s*\(\s*['\"]sha1['\"]",
]
_IP = r"[\"'](\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})[\"']"
_FILE_OPS = r"\b(open|os\.path\.(join|exists|isfile)|pathlib\.Path|fs\.(readFile|writeFile|readFileSync|writeFileSync|existsSync|createReadStream)|new\s+File\s*\(|Files\.(read|write|copy|move)|os\.Open|os\.Create|ioutil\.(ReadFile|WriteFile))\s*\("
_ANY_INPUT = r"(?i)(request\.(args|form|json|params|query|body|get_json)|req\.(body|query|params)|input\s*\(|sys\.argv|os\.environ\.get|getenv|ctx\.Param|c\.Query|r\.FormValue)"
_LOG_CALL = r"\b(log|logger|logging|console)\.(debug|info|warn|warning|error|critical|log)\s*\(|\bprint\s*\(|\bSystem\.out\.(print|println)\s*\(|\bfmt\.(Print|Println|Printf)\s*\("
_SENSITIVE = r"(?i)(password|passwd|secret|api_key|apikey|token|auth|credential|ssn|social.?security|credit.?card|cvv|pan\b|private.?key|access.?key|bearer)"
_CL004 = [
    r"(?i)password\s*[=:]\s*[\"'][^\"']{6,}[\"']",
    r"(?i)secret\s*[=:]\s*[\"'][^\"']{6,}[\"']",
    r"(?i)api[_-]?key\s*[=:]\s*[\"'][^\"']{8,}[\"']",
    r"(?i)token\s*[=:]\s*[\"'][^\"']{8,}[\"']",
]

#: CL003: numbers that need no name, and words around a number that explain it.
PLAIN_NUMBERS = (0, 1, 2, 4, 8, 10, 16, 32, 64, 100, 128, 256, 512, 1000, 1024)
HTTP_STATUS = (100, 599)
KNOWN_PORTS = (
    21, 22, 25, 53, 80, 110, 143, 443, 465, 587, 993, 995, 1433, 1521, 3000, 3306, 3389, 4200, 5000, 5432, 5672, 5900,
    6379, 6380, 8000, 8080, 8443, 8888, 9000, 9200, 9300, 11211, 15672, 27017, 27018, 50000,
)
NUMBER_CONTEXT = (
    "status", "port", "timeout", "retry", "version", "code", "http", "sleep", "delay", "max_length", "max_size", "limit",
    "expire", "ttl", "minutes", "seconds", "hours", "days", "years", "enum", "const", "final", "=", "bad",
)
NUMBER = r"(?<![\"'\w.])(\d{3,})\b(?![\"'])"
RUST_TEST = r"#\[(?:test|cfg\(test\))"
LOOP_LINE = r"^\s*(for|while)\b"
LOOP_WORD = r"\b(for|while)\b"
COMPILE_CALL = {PY: r"\bre\.compile\s*\(", JS: r"\bnew\s+RegExp\s*\(", TS: r"\bnew\s+RegExp\s*\("}
CONCAT = {PY: r"\b\w+\s*\+=\s*[\"']|\b\w+\s*=\s*\w+\s*\+\s*[\"']", JA: r"\b\w+\s*\+=\s*\"|\bString\s+\w+\s*=\s*\w+\s*\+\s*\""}

RULES: list[Rule] = [
    Rule("PY001", (PY,), "high", "quality", 0.95, "Bare except clause catches all exceptions", Re(r"^except:$", "stripped") | Starts("except:  ") | Starts("except: #")),
    Rule("PY002", (PY,), "high", "quality", 0.9, "Mutable default argument", Re(r"def\s+\w+\s*\([^)]*=\s*(\[\s*\]|\{\s*\}|\[\]|\{\})[^)]*\)")),
    Rule("PY003", (PY,), "critical", "security", 0.9, "Dangerous use of `{}()`", Re(r"\b(eval|exec)\s*\("), (HASH,), (r"\b(eval|exec)\s*\(", 1)),
    Rule("PY004", (PY,), "critical", "security", 0.85, "Hardcoded credential or secret", any_re(_PY004) & ~Has("os.environ") & ~Has("getenv"), (HASH,)),
    Rule(
        "PY005", (PY,), "critical", "security", 0.8, "Potential SQL injection via string formatting",
        Re(r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE)\s") & Re(r"(%s|%d|\{[^}]*\}|f[\"'].*\{)") & (Has("execute") | Re(r"(?i)query") | Has("execute", "prev")),
    ),
    Rule("PY006", (PY,), "medium", "quality", 0.95, "High cyclomatic complexity: {}", kind="complexity", least=10),
    Rule("PY007", (PY,), "medium", "quality", 0.9, "Function `{}` is too long ({} lines)", kind="long_function", least=50),
    Rule("PY008", (PY,), "medium", "quality", 0.9, "Excessive nesting depth: {} levels", kind="nesting", least=6),
    Rule(
        "PY009", (PY,), "low", "quality", 0.7, "Missing return type hint on `{}`",
        Re(r"^def\s+([a-zA-Z][a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*:", "stripped") & ~Has("->"), (), (r"^\s*def\s+([a-zA-Z][a-zA-Z0-9_]*)\s*\(", 1),
    ),
    Rule(
        "PY010", (PY,), "critical", "security", 0.9, "Unsafe deserialization (pickle / yaml.load)",
        any_re([r"\bpickle\.loads?\s*\(", r"\bshelve\.open\s*\(", r"\bjsonpickle\.decode\s*\(", r"\bdill\.loads?\s*\("])
        | Re(r"\byaml\.load\s*\((?!.*Loader\s*=\s*yaml\.SafeLoader)", re2=r"(regexp_matches({t}, '\byaml\.load\s*\(') and not regexp_matches({t}, '\byaml\.load\s*\(.*Loader\s*=\s*yaml\.SafeLoader'))"),
        (HASH,),
    ),
    Rule("PY011A", (PY,), "critical", "security", 0.88, "OS command injection via os.system / os.popen", Re(r"\bos\.(system|popen)\s*\(") & Re(_INTERPOLATION), (HASH,)),
    Rule(
        "PY011B", (PY,), "critical", "security", 0.9, "Command injection via subprocess shell=True",
        Re(r"\bsubprocess\.(run|call|Popen|check_output|check_call)\s*\(") & Re(r"shell\s*=\s*True", (0, 5)) & Re(_INTERPOLATION, (0, 5)) & ~(Re(r"\bos\.(system|popen)\s*\(") & Re(_INTERPOLATION)),
        (HASH,),
    ),
    Rule(
        "PY012", (PY,), "medium", "security", 0.8, "Cryptographically weak PRNG used for security value",
        Re(r"\brandom\.(random|randint|randrange|choice|choices|sample|uniform)\s*\(") & Re(r"(?i)(token|secret|password|passwd|session|otp|nonce|salt|csrf|key|auth|pin|code)", (-5, 5)), (HASH,),
    ),
    Rule(
        "PY013", (PY,), "high", "security", 0.75, "Potential XML External Entity (XXE) injection",
        (
            any_re([r"XMLParser\s*\(.*resolve_entities\s*=\s*True", r"xml\.etree\.ElementTree\.(parse|fromstring)\s*\(", r"minidom\.parse\s*\(", r"sax\.parse\s*\("])
            | Re(r"etree\.parse\s*\((?!.*defusedxml)", re2=r"(regexp_matches({t}, 'etree\.parse\s*\(') and not regexp_matches({t}, 'etree\.parse\s*\(.*defusedxml'))")
        )
        & ~Re(r"defusedxml|no_network\s*=\s*True|resolve_entities\s*=\s*False", "code"),
        (HASH,),
    ),
    Rule("PY014", (PY,), "high", "security", 0.75, "Potential SSRF — HTTP request with user-controlled URL", Re(_HTTP_CALL) & Re(_PY_INPUT, (-14, 0)), (HASH,)),
    Rule("JS001", (JS, TS), "low", "quality", 0.9, "Use of `var` — prefer `let` or `const`", Re(r"\bvar\s+\w+"), (SLASH, STAR)),
    Rule("JS002", (JS, TS), "low", "quality", 0.85, "console.log() debug statement found", Re(r"\bconsole\.(log|debug)\s*\("), (SLASH, STAR)),
    Rule("JS003", (JS, TS), "high", "security", 0.85, "Potential XSS via unsafe HTML injection", Re(r"\.(innerHTML|outerHTML)\s*=|dangerouslySetInnerHTML\s*=\s*\{"), (SLASH,)),
    Rule("TS001", (TS,), "medium", "quality", 0.85, "TypeScript `any` type defeats type safety", Re(r":\s*any\b|<any>|as\s+any\b"), (SLASH, STAR)),
    Rule("JS004", (JS, TS), "medium", "quality", 0.8, "Deep callback nesting: {} levels", kind="nesting", least=5),
    Rule("JS005A1", (JS, TS), "high", "security", 0.9, "`jwt.decode()` skips signature verification", Re(r"\bjwt\.decode\s*\(") & ~Re(r"\bjwt\.verify\s*\(", "code"), (SLASH, STAR)),
    Rule("JS005A2", (JS, TS), "medium", "security", 0.75, "JWT verify missing explicit `algorithms` whitelist", Re(r"\bjwt\.verify\s*\(") & ~Re(r"algorithms\s*:\s*\[", "code"), (SLASH, STAR)),
    Rule("JS006", (JS, TS), "high", "security", 0.8, "Prototype pollution — unguarded object merge", Re(r"(target|dest|obj|result)\[(\w+)\]\s*=\s*(source|src|from)\[") & ~Re(_PROTO_GUARD, "code"), (SLASH, STAR)),
    Rule(
        "TS002", (TS,), "medium", "quality", 0.72, "Non-null assertion operator (`!`) used",
        Re(r"\w+!\s*(?:[.\[;,)\s]|$)") & ~Re(r"(?:if|while|&&|\|\|)\s*\(?\s*!\w"), (SLASH, STAR), kind="first_of", least=3,
    ),
    Rule("JS005B", (JS, TS), "low", "quality", 0.65, "`async` function with no `await`", Re(r"\basync\s+(?:function\s*\w*\s*\(|(?:\(|[\w]+)\s*=>)") & ~Re(r"\bawait\b", (0, 30)), (SLASH, STAR)),
    Rule("GO001", (GO,), "high", "quality", 0.88, "Error return value discarded with `_`", Re(r"\b(\w+(?:,\s*\w+)*),\s*_\s*:?=") & Re(_MUST_CHECK), (SLASH,)),
    Rule("GO002", (GO,), "high", "quality", 0.82, "`panic()` used in library code", Re(r"\bpanic\s*\(") & ~(Has("package main", "code") & Re(r"(?m)^func\s+main\s*\(\s*\)", "code")), (SLASH,)),
    Rule("GO003", (GO,), "medium", "quality", 0.75, "Goroutine launched without synchronization", Re(r"\bgo\s+func\s*\(") & ~Re(_GO_SYNC, "code"), (SLASH,)),
    Rule("GO004", (GO,), "critical", "security", 0.85, "SQL injection via string formatting", Re(r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\s") & Re(r"fmt\.(Sprintf|Fprintf)\s*\(|string\s*\+|%[sdvf]"), (SLASH,)),
    Rule("GO005", (GO,), "medium", "quality", 0.80, "Mutex.Lock() without `defer Unlock()`", Re(r"\b\w+\.(Lock|RLock)\s*\(\s*\)") & ~Re(r"\bdefer\s+[\w.]+\.(Unlock|RUnlock)\s*\(\s*\)", (1, 3)), (SLASH,)),
    Rule("GO006", (GO,), "low", "quality", 0.85, "`context.Context` is not the first parameter", Re(r"^func\s+\w+\s*\([^),]*,[^)]*context\.Context[^)]*\)", "stripped") & ~Re(r"^func\s+\w+\s*\([^),]*context\.Context", "stripped")),
    Rule("GO007", (GO,), "low", "maintainability", 0.8, "Hardcoded IP address: {}", FirstNotIn(_IP, 1, ("0.0.0.0", "127.0.0.1", "255.255.255.255")), (SLASH,), (_IP, 1)),
    Rule(
        "GO008", (GO,), "medium", "quality", 0.72, "Unbuffered channel send without concurrent receiver",
        Re(r"\bmake\s*\(\s*chan\s+\w[\w.*\[\]]*\s*\)") & Re(r"\b\w+\s*<-\s*\w", (1, 20)) & ~Re(r"\bgo\s+func\b|\bgo\s+\w+\s*\(", "code"), (SLASH,),
    ),
    Rule("JA001", (JA,), "low", "quality", 0.92, "System.out.println() found — use a logging framework", Re(r"\bSystem\.(out|err)\.(println|print|printf)\s*\("), (SLASH, STAR)),
    Rule("JA002", (JA,), "medium", "quality", 0.80, "Raw type `{}` used without type parameter", Re(_RAW_TYPES), (SLASH, STAR, "import"), (_RAW_TYPES, 1)),
    Rule("JA003", (JA,), "high", "quality", 0.82, "`{}` opened without try-with-resources", Re(_RESOURCES) & ~Re(r"\btry\s*\(", (-2, 0)), (SLASH, STAR), (_RESOURCES, 1)),
    Rule("JA004", (JA,), "medium", "quality", 0.88, "Overly broad `catch ({})`", Re(r"\bcatch\s*\(\s*(Exception|RuntimeException|Throwable)\s+\w+"), (SLASH, STAR), (r"\bcatch\s*\(\s*(Exception|RuntimeException|Throwable)\s+\w+", 1)),
    Rule("JA005", (JA,), "critical", "security", 0.87, "SQL injection via string concatenation", Re(r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\s") & Re(r"\"\s*\+\s*\w+|\bString\.format\s*\("), (SLASH, STAR)),
    Rule("JA006", (JA,), "high", "quality", 0.75, "Potential NullPointerException — chained call on nullable", Re(r"\b\w+\.(get|find|first|peek|poll|remove)\s*\([^)]*\)\.|\bOptional\.empty\b") & Has(".get("), (SLASH, STAR)),
    Rule("RS001", (RS,), "medium", "quality", 0.85, "`.unwrap()` may panic on `None` or `Err`", Re(r"\.(unwrap)\s*\(\s*\)"), (SLASH,), kind="outside_tests"),
    Rule("RS002", (RS,), "high", "security", 0.92, "`unsafe` block — memory safety not guaranteed", Re(r"\bunsafe\s*\{"), (SLASH,)),
    Rule("RS003", (RS,), "high", "quality", 0.9, "`{}!()` macro panics at runtime", Re(r"\b(todo|unimplemented|unreachable)\s*!\s*\("), (SLASH,), (r"\b(todo|unimplemented|unreachable)\s*!\s*\(", 1)),
    Rule("RS004", (RS,), "low", "performance", 0.70, "Excessive `.clone()` usage ({} occurrences)", Re(r"\.clone\s*\(\s*\)"), (SLASH,), kind="count_of", least=5),
    Rule("RS005", (RS,), "low", "quality", 0.75, '`.expect("{}")` — message too vague', Re(r"\.expect\s*\(\s*\"([^\"]{0,10})\"\s*\)"), (SLASH,), (r"\.expect\s*\(\s*\"([^\"]{0,10})\"\s*\)", 1)),
    Rule("PERF001", (PY, JS, TS), "medium", "performance", 0.82, "{}", kind="loop_body"),
    Rule("PERF002", (PY, JA), "medium", "performance", 0.80, "String concatenation inside loop (O(n²))", skip=(HASH, SLASH), kind="after_loop"),
    Rule(
        "PERF003", ALL, "high", "security", 0.88, "Weak cryptographic hash: MD5 or SHA-1",
        any_re(_WEAK_HASH) & (Re(r"(?i)(password|passwd|signature|sign|hmac|auth|token|credential|integrity)", (-9, 5)) | Has("hashlib.md5") | Has("MessageDigest")), (HASH, SLASH, STAR),
    ),
    Rule("PERF004", (PY, JS, TS, JA, GO), "high", "security", 0.78, "Potential path traversal — user input in file path", Re(_FILE_OPS) & Re(_ANY_INPUT, (-14, 0)), (HASH, SLASH, STAR)),
    Rule("PERF005", ALL, "high", "security", 0.82, "Sensitive data logged — potential data exposure", Re(_LOG_CALL) & Re(_SENSITIVE), (HASH, SLASH, STAR)),
    Rule("CL001", ALL, "info", "quality", 0.95, "{} comment found", Re(r"(?i)#.*\b(TODO|FIXME|HACK|XXX|BUG)\b|//.*\b(TODO|FIXME|HACK|XXX|BUG)\b"), kind="todo"),
    Rule("CL002", ALL, "medium", "quality", 0.95, "File is very large ({} lines)", kind="large_file", least=500),
    Rule("CL003", ALL, "low", "quality", 0.7, "Magic number: {}", ~Has("import", "stripped") & ~Has('"""', "stripped") & ~Has("'''", "stripped"), (HASH, SLASH, STAR), kind="numbers"),
    Rule("CL004", ALL, "critical", "security", 0.85, "Hardcoded credential detected", any_re(_CL004) & ~any_of([Has(s) for s in ("os.environ", "process.env", "getenv", "config.")]), (HASH, SLASH, STAR)),
]

#: Rules of the user's own, run after those above in the order in which they were registered.
REGISTERED: list[Rule] = []


def register(rule: Rule) -> None:
    """Add a rule: predicates join the projection over lines, a function is called once a file."""
    if any(r.key == rule.key for r in every_rule()):
        raise ValueError(f"there is a rule {rule.key} already")
    REGISTERED.append(rule)


def unregister(key: str) -> None:
    REGISTERED[:] = [r for r in REGISTERED if r.key != key]


def every_rule() -> list[Rule]:
    return [*RULES, *REGISTERED]
