"""Sources, sinks and sanitizers of tainted data, by language.

--- Fixed values: the patterns that candidates are compared by.  A source is (kind, call or attr, pattern), a sink
(kind, pattern), a sanitizer a pattern; each pattern is a substring of a line. ---
"""

from __future__ import annotations

import hashlib

_JS_SOURCES = [
    ("http_param", "attr", "req.query"),
    ("http_param", "attr", "req.params"),
    ("http_body", "attr", "req.body"),
    ("http_param", "attr", "request.query"),
    ("http_param", "attr", "request.params"),
    ("http_body", "attr", "request.body"),
    ("http_param", "call", "URLSearchParams"),
    ("http_param", "attr", "location.search"),
    ("http_param", "attr", "location.hash"),
    ("user_input", "call", "document.getElementById"),
    ("user_input", "attr", ".value"),
    ("env_var", "attr", "process.env"),
    ("argv", "attr", "process.argv"),
    ("deserialized", "call", "JSON.parse("),
]

_SOURCES = {
    "python": [
        ("http_param", "call", "request.args.get"),
        ("http_param", "attr", "request.args"),
        ("http_body", "attr", "request.form"),
        ("http_body", "attr", "request.json"),
        ("http_body", "attr", "request.data"),
        ("http_param", "call", "request.get_json"),
        ("http_param", "attr", "request.GET"),
        ("http_body", "attr", "request.POST"),
        ("http_body", "attr", "request.body"),
        ("http_param", "attr", "Query("),
        ("http_body", "attr", "Body("),
        ("env_var", "call", "os.environ.get"),
        ("env_var", "attr", "os.environ"),
        ("env_var", "call", "os.getenv"),
        ("file_read", "call", "open("),
        ("file_read", "call", ".read("),
        ("file_read", "call", ".readline("),
        ("argv", "attr", "sys.argv"),
        ("user_input", "call", "input("),
        ("deserialized", "call", "pickle.loads"),
        ("deserialized", "call", "json.loads"),
        ("deserialized", "call", "yaml.load"),
        ("deserialized", "call", "yaml.safe_load"),
    ],
    "javascript": _JS_SOURCES,
    "typescript": _JS_SOURCES,
    "go": [
        ("http_param", "attr", "r.URL.Query()"),
        ("http_param", "call", "r.FormValue("),
        ("http_param", "call", "r.PostFormValue("),
        ("http_param", "attr", "r.URL.Path"),
        ("http_body", "call", "io.ReadAll(r.Body"),
        ("http_body", "call", "ioutil.ReadAll(r.Body"),
        ("http_body", "call", "json.NewDecoder(r.Body"),
        ("http_param", "call", "c.Query("),
        ("http_param", "call", "c.Param("),
        ("http_body", "call", "c.ShouldBindJSON("),
        ("http_body", "call", "c.BindJSON("),
        ("env_var", "call", "os.Getenv("),
        ("argv", "attr", "os.Args"),
        ("file_read", "call", "os.Open("),
        ("file_read", "call", "os.ReadFile("),
        ("file_read", "call", "ioutil.ReadFile("),
    ],
    "rust": [
        ("http_param", "attr", "web::Query"),
        ("http_body", "attr", "web::Json"),
        ("http_body", "attr", "web::Form"),
        ("http_param", "call", "req.match_info().get("),
        ("http_param", "attr", "extract::Path"),
        ("http_param", "attr", "extract::Query"),
        ("http_body", "attr", "extract::Json"),
        ("env_var", "call", "env::var("),
        ("env_var", "call", "std::env::var("),
        ("argv", "call", "env::args("),
        ("deserialized", "call", "serde_json::from_str("),
        ("deserialized", "call", "serde_json::from_reader("),
    ],
    "java": [
        ("http_param", "call", "request.getParameter("),
        ("http_param", "call", "request.getParameterValues("),
        ("http_body", "call", "request.getInputStream("),
        ("http_body", "call", "request.getReader("),
        ("http_param", "call", "request.getAttribute("),
        ("http_param", "attr", "@RequestParam"),
        ("http_param", "attr", "@PathVariable"),
        ("http_body", "attr", "@RequestBody"),
        ("env_var", "call", "System.getenv("),
        ("env_var", "call", "System.getProperty("),
    ],
}

_JS_SINKS = [
    ("code_exec", "eval("),
    ("code_exec", "new Function("),
    ("dom_write", ".innerHTML"),
    ("dom_write", ".outerHTML"),
    ("dom_write", "document.write("),
    ("dom_write", "dangerouslySetInnerHTML"),
    ("shell_exec", "child_process.exec("),
    ("shell_exec", "child_process.spawn("),
    ("shell_exec", "exec("),
    ("ssrf_fetch", "fetch("),
    ("ssrf_fetch", "axios.get("),
    ("sql_query", ".query("),
    ("sql_query", ".raw("),
]

_SINKS = {
    "python": [
        ("code_exec", "eval("),
        ("code_exec", "exec("),
        ("code_exec", "compile("),
        ("shell_exec", "os.system("),
        ("shell_exec", "os.popen("),
        ("shell_exec", "subprocess.run("),
        ("shell_exec", "subprocess.call("),
        ("shell_exec", "subprocess.Popen("),
        ("sql_query", ".execute("),
        ("sql_query", ".executemany("),
        ("sql_query", ".raw("),
        ("path_traversal", "open("),
        ("path_traversal", "Path("),
        ("ssrf_fetch", "requests.get("),
        ("ssrf_fetch", "requests.post("),
        ("ssrf_fetch", "httpx.get("),
        ("ssrf_fetch", "httpx.AsyncClient().get("),
        ("ssrf_fetch", "client.get("),
        ("ssrf_fetch", "urllib.request.urlopen("),
        ("deserialized", "pickle.loads("),
        ("deserialized", "yaml.load("),
    ],
    "javascript": _JS_SINKS,
    "typescript": _JS_SINKS,
    "go": [
        ("sql_query", "db.Query("),
        ("sql_query", "db.QueryRow("),
        ("sql_query", "db.Exec("),
        ("sql_query", ".Query("),
        ("sql_query", ".Exec("),
        ("shell_exec", "exec.Command("),
        ("shell_exec", "syscall.Exec("),
        ("path_traversal", "os.Open("),
        ("path_traversal", "os.Create("),
        ("path_traversal", "filepath.Join("),
        ("ssrf_fetch", "http.Get("),
        ("ssrf_fetch", "http.Post("),
        ("ssrf_fetch", "client.Get("),
        ("ssrf_fetch", "client.Do("),
        ("template_render", "fmt.Sprintf("),
        ("template_render", "template.HTML("),
    ],
    "rust": [
        ("sql_query", "query!("),
        ("sql_query", "query_as!("),
        ("sql_query", "execute("),
        ("sql_query", "sqlx::query("),
        ("shell_exec", "Command::new("),
        ("shell_exec", ".arg("),
        ("path_traversal", "File::open("),
        ("path_traversal", "fs::read("),
        ("path_traversal", "PathBuf::from("),
        ("ssrf_fetch", "reqwest::get("),
        ("ssrf_fetch", "client.get("),
    ],
    "java": [
        ("sql_query", ".executeQuery("),
        ("sql_query", ".executeUpdate("),
        ("sql_query", ".execute("),
        ("sql_query", "createQuery("),
        ("shell_exec", "Runtime.exec("),
        ("shell_exec", "ProcessBuilder("),
        ("path_traversal", "new File("),
        ("path_traversal", "Paths.get("),
        ("path_traversal", "Files.readAllBytes("),
        ("ssrf_fetch", "new URL("),
        ("ssrf_fetch", "HttpURLConnection"),
        ("deserialized", ".readObject("),
        ("deserialized", "ObjectInputStream("),
    ],
}

SANITIZERS = {
    "python": ["html.escape(", "bleach.clean(", "bleach.linkify(", "shlex.quote(", "shlex.split(", "re.fullmatch(", "re.match(", "hashlib.", ".encode(", "int(", "float(", "str(", "bool(", "uuid.UUID("],
    "javascript": ["DOMPurify.sanitize(", "encodeURIComponent(", "encodeURI(", "escape(", "parseInt(", "parseFloat(", "Number(", "String(", "Boolean(", "JSON.stringify("],
    "typescript": ["DOMPurify.sanitize(", "encodeURIComponent(", "encodeURI(", "parseInt(", "parseFloat(", "Number(", "String(", "Boolean(", "JSON.stringify("],
    "go": ["html.EscapeString(", "url.QueryEscape(", "url.PathEscape(", "filepath.Clean(", "filepath.Base(", "strconv.Atoi(", "strconv.ParseInt(", "strconv.ParseFloat(", "regexp.MustCompile(", "strings.ReplaceAll("],
    "rust": ["html_escape::encode_text(", "percent_encoding::utf8_percent_encode(", "sanitize_html(", ".parse::<i32>()", ".parse::<u64>()", ".parse::<f64>()", "Uuid::parse_str("],
    "java": ["ESAPI.encoder().encodeForHTML(", "ESAPI.encoder().encodeForSQL(", "HtmlUtils.htmlEscape(", "StringEscapeUtils.escapeHtml4(", "StringEscapeUtils.escapeSql(", "Integer.parseInt(", "Long.parseLong(", "UUID.fromString(", "Jsoup.clean("],
}

RESERVED = {"return", "if", "for", "while", "import", "from", "class", "def"}
ASSIGNMENT = {"python": r"^(\w+)\s*=\s*(.+)$", "other": r"^(?:const|let|var)?\s*(\w+)\s*=\s*(.+)$"}
INTERPOLATED = {"python": r"f[\"'].*\{(\w+)\}", "javascript": r"`[^`]*\$\{(\w+)\}[^`]*`", "typescript": r"`[^`]*\$\{(\w+)\}[^`]*`"}

# --- End of the fixed values. ---


def _sign(*parts: str) -> str:
    return hashlib.sha256(":".join(parts).encode()).hexdigest()[:12]


def sources() -> list[dict]:
    """ord, language, kind, call_pattern, attr_pattern, pattern, signature."""
    out = []
    for language, rows in _SOURCES.items():
        for kind, how, pattern in rows:
            call, attr = (pattern, None) if how == "call" else (None, pattern)
            out.append({"ord": len(out), "language": language, "kind": kind, "call_pattern": call, "attr_pattern": attr, "pattern": pattern, "signature": _sign(kind, language, str(call), str(attr))})
    return out


def sinks() -> list[dict]:
    """ord, language, kind, pattern, signature, shell_only (calls that only a shell flag makes dangerous)."""
    out = []
    for language, rows in _SINKS.items():
        for kind, pattern in rows:
            out.append({"ord": len(out), "language": language, "kind": kind, "pattern": pattern, "signature": _sign(kind, language, pattern), "shell_only": pattern.startswith("subprocess.")})
    return out
