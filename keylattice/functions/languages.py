"""What tells a token in each language with rules of its own, as data.

A language has header patterns (with how a body ends: b braces, i indentation,
e the word end), words of its statements, names, marks above a header, called
methods by object, and types that a class descends from.
"""

from __future__ import annotations

import re
from typing import NamedTuple


def _words(**by_token: str) -> dict[str, str]:
    return {w: t for t, ws in by_token.items() for w in ws.split()}


class Language(NamedTuple):
    headers: list[tuple[re.Pattern, str]]
    words: dict[str, str]
    names: dict[str, tuple[str, float]]
    calls: dict[str, str]
    objects: dict[str, str]
    marks: list[tuple[re.Pattern, str, float]] = []
    bases: list[tuple[re.Pattern, str, float]] = []
    #: (method, object, token, confidence); either may be empty, which fits any
    pairs: list[tuple[str, str, str, float]] = []
    symbols: list[tuple[re.Pattern, str]] = []
    #: names and methods are compared in lower case
    fold: bool = False
    #: prefix of test names, compared in the name's own case, and its confidence
    test: tuple[str, float] = ("test", 0.95)
    #: a method behind a dot is a call without brackets
    bare: bool = False


_CALLS = {
    "PERSIST": "add create insert persist put save store upsert write", "FETCH": "fetch filter find get load query read select", "EMIT": "broadcast dispatch emit publish send trigger",
    "SUBSCRIBE": "on subscribe listen", "TRANSFORM": "convert decode deserialize encode format map parse serialize transform", "MUTATE": "append clear delete patch pop push remove set splice update",
    "VALIDATE": "assert check ensure validate verify",
}


def _calls(**more: str) -> dict[str, str]:
    return _words(**{t: f"{_CALLS.get(t, '')} {more.get(t, '')}" for t in {**_CALLS, **more}})


_METERS = "counter gauge histogram metrics prometheus statsd telemetry timer"
_BRACED = dict(OUTPUT="return", RAISE="throw", CONDITIONAL="if switch", LOOP="for while do", RECOVER="catch", DEFER="finally")


def _names(init: str, teardown: str, sure: float = 0.95) -> dict[str, tuple[str, float]]:
    return {w: (t, sure) for t, ws in (("INIT", init), ("TEARDOWN", teardown)) for w in ws.split()}


def _bases(contract: str = "", persist: str = "", listen: str = "", route: str = "", guard: str = "", *more: tuple[str, str, float]) -> list[tuple[re.Pattern, str, float]]:
    usual = [
        (f"(?:BaseModel|DTO|Entity|Model|Schema|Serializable|ValueObject{contract})$", "CONTRACT", 0.9), ("(?:Error|Exception|Fault)$", "RAISE", 0.9), ("(?:Spec|Suite|TestCase)$", "TEST", 0.9),
        (f"(?:Dao|Repository|Store{persist})$", "PERSIST", 0.9), (f"(?:Consumer|Handler|Listener|Subscriber{listen})$", "SUBSCRIBE", 0.9), (f"(?:Controller|Router|View{route})$", "ROUTE", 0.9),
        (f"(?:Guard{guard})$", "AUTHENTICATE", 0.9), ("(?:Access|Permission|Role)Guard$", "AUTHORIZE", 0.9), *more,
    ]
    return [(re.compile(p), t, c) for p, t, c in usual]


def _marks(*rows: tuple[str, str, float]) -> list[tuple[re.Pattern, str, float]]:
    return [(re.compile(p), t, c) for p, t, c in rows]


def _heads(*rows: tuple[str, str]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p), how) for how, p in rows]


_NOT = r"(?!\s*(?:return|throw|new|else|await|yield|case|package|import|using|delete|goto|typedef|if|for|while|switch|catch|foreach|lock|do)\b)"
_TYPED = rf"{_NOT}\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:[\w.<>\[\],?&*:]+\s+)+[*&]*(\w+)\s*\([^;{{]*(?:\{{.*)?$"
_JVM_ROUTES = r"@(?:Delete|Get|Patch|Post|Put|Request)Mapping\b|@(?:Rest)?Controller\b"
_SCRIPT = Language(
    _heads(
        ("b", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([\w$]+)\s*[<(]"),
        ("b", r"\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)"),
        ("b", rf"{_NOT}\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{=]+)?\{{"),
    ),
    _words(**_BRACED, EMIT="yield", ASYNC="await"),
    _names(
        "beforeAll beforeEach componentDidMount componentDidUpdate componentWillMount init initialize ngAfterContentInit ngAfterViewInit ngOnChanges ngOnInit onInit onStartup setup setUp startup",
        "afterAll afterEach cleanup componentWillUnmount destroy dispose ngAfterViewDestroyed ngOnDestroy onDestroy onShutdown shutdown teardown tearDown",
    ),
    _calls(EMIT="next", SUBSCRIBE="addListener addEventListener pipe", FETCH="findOne findAll findBy", VALIDATE="assertValid"),
    _words(LOG="bunyan console log logger Logger pino winston", MEASURE=_METERS),
    _marks(
        (r"@(?:EventPattern|MessagePattern|On|Subscribe)\b", "SUBSCRIBE", 0.9), (r"@(?:Controller|Delete|Get|Patch|Post|Put)\b", "ROUTE", 0.9), (r"@(?:Auth|UseGuards)\b", "AUTHENTICATE", 0.9),
        (r"@(?:Permissions|Roles)\b", "AUTHORIZE", 0.9), (r"@Injectable\b", "CONTRACT", 0.9), (r"@(?:[Vv]alidate|ValidateNested|IsValid)\b", "VALIDATE", 0.9), (r"@UseInterceptors\b", "DELEGATE", 0.9),
        (r"@(?:[Tt]ransactional|Transaction)\b", "SCOPE", 0.9), (r"@(?:[Rr]etry|[Bb]ackoff)\b", "RECOVER", 0.9), (r"@(?:[Mm]emoize|[Cc]ache|CacheKey)\b", "FETCH", 0.8),
    ),
    _bases("|Enum", "", "", "|ControllerBase", "|CanActivate(?:Child)?|CanDeactivate"),
    [("describe", "", "TEST", 0.75)],
    [(re.compile(r"(?:\.[\w$]+|\])\s*=(?![=>])|[\w$\])]\s*(?:[-+*/%&|^]|\*\*|\?\?|\|\||&&|<<|>>)=(?!=)"), "MUTATE")],
)

LANGUAGES: dict[str, Language] = {
    "typescript": _SCRIPT, "javascript": _SCRIPT, "tsx": _SCRIPT,
    "go": Language(
        _heads(("b", r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]")),
        _words(OUTPUT="return", ASYNC="go", DEFER="defer", CONDITIONAL="if switch select", LOOP="for"), _names("init setup bootstrap", "cleanup close shutdown teardown"),
        _calls(
            PERSIST="exec execcontext writeall writefile writeto", FETCH="findall findby findone lookup querycontext queryrow queryrowcontext readall readfile scan search", EMIT="next notify fire",
            SUBSCRIBE="receive watch observe", TRANSFORM="marshal marshaljson unmarshal unmarshaljson", VALIDATE="ispresent isvalid", RAISE="fatal fatalf fatalln panic", RECOVER="recover", ASYNC="spawn",
            TEARDOWN="cancel close done release rwunlock shutdown stop unlock wait", AUTHENTICATE="authenticate checkpassword login signin verifycredentials verifypassword verifytoken",
            AUTHORIZE="authorize canaccess checkpermission haspermission requireauth requirepermission requirerole",
        ),
        _words(LOG="glog klog log logger logrus slog zap zerolog", MEASURE=f"{_METERS} meter tracer span otel observability"),
        pairs=[(m, o, "ROUTE", 0.85) for m in "any delete get group handle handlefunc head options patch pathprefix post put subrouter use".split() for o in "api app chi echo engine fiber g gin http mux r rg router v1 v2".split()],
        symbols=[(re.compile(r"[\w\])]\s*<-"), "EMIT"), (re.compile(r"(?<![\w\])\s])\s*<-\s*\w"), "SUBSCRIBE")], fold=True,
    ),
    "java": Language(
        _heads(("b", _TYPED)), _words(**_BRACED, SCOPE="synchronized"),
        _names("beforeall beforeeach init initialize oninit onstartup setup startup", "afterall aftereach cleanup destroy dispose onshutdown shutdown teardown"),
        _calls(FETCH="findone findall findby", EMIT="next", SUBSCRIBE="addlistener pipe", VALIDATE="assertvalid", RAISE="panic fail error", RECOVER="recover retry", ASYNC="runasync supplyasync thenapplyasync thencomposeasync"),
        _words(LOG="console logger log", MEASURE=_METERS),
        _marks(
            (r"@Before(?:All|Each)\b", "INIT", 0.9), (r"@(?:After(?:All|Each)|PreDestroy)\b", "TEARDOWN", 0.9), (r"@(?:Parameterized|Repeated)?Test\b", "TEST", 0.9),
            (r"@\w*(?:Get|Post|Put|Delete|Patch|RequestMapping|Route|Controller)(?!\w)", "ROUTE", 0.9), (r"@\w*(?:Auth|Authenticated|Secured|PreAuthorize|RolesAllowed)(?!\w)", "AUTHENTICATE", 0.9),
            (r"@\w*(?:Authorize|Permissions|RolesAllowed)(?!\w)", "AUTHORIZE", 0.9), (r"@\w*(?:Bean|Component|Configuration|Repository|Service)(?!\w)", "CONTRACT", 0.9),
            (r"@Transactional\b", "SCOPE", 0.9), (r"@(?:Recover|Retryable)\b", "RECOVER", 0.9), (r"@Async\b", "ASYNC", 0.9),
        ),
        _bases("|Interface|Record", "", "", "", "|AuthFilter|Authenticator", ("(?:Callable|CompletionStage|Runnable)$", "ASYNC", 0.85)), fold=True,
    ),
    "rust": Language(
        _heads(("b", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"?\w*\"?\s+)*fn\s+(\w+)\s*[<(]")),
        _words(OUTPUT="return", CONDITIONAL="if match", LOOP="for while loop", ASYNC="await"), _names("default init initialize setup", "cleanup drop shutdown teardown"),
        _calls(FETCH="find_one find_all find_by", EMIT="next", SUBSCRIBE="poll_next", TRANSFORM="into from", RAISE="panic bail", RECOVER="recover or_else unwrap_or_else", ASYNC="spawn spawn_blocking"),
        _words(LOG="log logger tracing", MEASURE=_METERS),
        _marks((r"#\[(?:\w+::)?test\]", "TEST", 0.9), (r"#\[(?:async_std|tokio)::main\]", "INIT", 0.9), (r"#\[(?:delete|get|patch|post|put|route)", "ROUTE", 0.9)),
        [(re.compile(f"^{b}$"), t, 0.85) for t, bs in {"TRANSFORM": "From Into TryFrom TryInto", "CONTRACT": "Debug Deserialize Display Serialize", "EMIT": "Iterator Stream AsyncIterator", "TEARDOWN": "Drop", "INIT": "Default", "RAISE": "Error"}.items() for b in bs.split()],
        [("insert", "", "MUTATE", 0.75)], [(re.compile(r"\)\s*\?"), "RECOVER")], fold=True,
    ),
    "ruby": Language(
        _heads(("e", r"\s*def\s+(?:self\.)?(\w+)[!?=]?")),
        _words(OUTPUT="return", EMIT="yield", LOOP="for while until", CONDITIONAL="if unless case", RECOVER="rescue", DEFER="ensure", RAISE="raise fail"),
        _names("before_all before_each initialize setup", "after_all after_each cleanup shutdown tear_down teardown"),
        _calls(FETCH="find_by find_or_create_by", VALIDATE="valid", RAISE="raise fail", RECOVER="recover retry", ASYNC="async delay deliver_later enqueue_later perform_async", MUTATE="merge"),
        _words(LOG="logger log rails.logger", MEASURE=_METERS), bases=_bases("", "", "", "", "|Authenticator"), fold=True, bare=True,
    ),
    "csharp": Language(
        _heads(("b", _TYPED)), _words(**{**_BRACED, "LOOP": "do for foreach while"}, EMIT="yield", ASYNC="await"),
        _names("Init Initialize Main OnStart OnStartAsync Setup SetUp StartAsync", "Cleanup Close Dispose Finalize Shutdown StopAsync TearDown TearDownAsync"),
        _calls(FETCH="findone findall findby", EMIT="next", SUBSCRIBE="addlistener", VALIDATE="assertvalid", RAISE="panic fail error", RECOVER="recover retry", ASYNC="runasync supplyasync thenapplyasync thencomposeasync"),
        _words(LOG="console logger log", MEASURE=_METERS),
        _marks(
            (r"\[(?:Fact|Test|TestMethod|Theory)\b", "TEST", 0.9), (r"\[(?:Http(?:Delete|Get|Patch|Post|Put)|ApiController)\b|\[Route\(", "ROUTE", 0.9), (r"\[(?:AllowAnonymous|Authorize)\b", "AUTHENTICATE", 0.9),
            (r"\[Transaction(?:al)?\b", "SCOPE", 0.9), (r"\[(?:Inject|Injectable|ServiceFilter)\b", "CONTRACT", 0.9), (r"\[(?:ClassInitialize|Set[uU]p)\b", "INIT", 0.9), (r"\[(?:ClassCleanup|TearDown)\b", "TEARDOWN", 0.9),
        ),
        _bases("", "", "", "|ControllerBase", "|CanActivate(?:Child)?|CanDeactivate"), fold=True, test=("Test", 0.95),
    ),
    "php": Language(
        _heads(("b", r"\s*(?:(?:abstract|final|private|protected|public|static)\s+)*function\s+&?(\w+)\s*\(")), _words(**{**_BRACED, "LOOP": "do for foreach while", "CONDITIONAL": "if switch match"}, EMIT="yield"),
        _names("__construct setUp setUpAfterClass setUpBeforeClass", "__destruct tearDown tearDownAfterClass"),
        _calls(FETCH="findone findall findby", EMIT="next", SUBSCRIBE="addlistener", VALIDATE="assertvalid", RAISE="panic fail error", RECOVER="recover retry"), _words(LOG="logger log console", MEASURE=_METERS),
        _marks((r"#\[(?:Delete|Get|Post|Put|Route)\(", "ROUTE", 0.9), (r"#\[(?:Auth|Middleware)\b", "AUTHENTICATE", 0.9), (r"#\[Test\b", "TEST", 0.9)), _bases("", "", "", "", "|Authenticator"), fold=True,
    ),
    "kotlin": Language(
        _heads(("b", r"\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:[a-z]+\s+)*fun\s+(?:<[^>]+>\s*)?(?:[\w.<>?]+\.)?(\w+)\s*\(")), _words(**{**_BRACED, "CONDITIONAL": "if when"}),
        _names("beforeAll beforeEach main setUp setUpClass", "afterAll afterEach tearDown tearDownClass"), _calls(FETCH="findone findall findby", EMIT="next", SUBSCRIBE="addlistener", VALIDATE="assertvalid"),
        _words(LOG="logger log console", MEASURE=_METERS),
        _marks(
            (r"@(?:Parameterized|Repeated)?Test\b", "TEST", 0.9), (_JVM_ROUTES, "ROUTE", 0.9), (r"@(?:PreAuthorize|RolesAllowed|Secured)\b", "AUTHORIZE", 0.9), (r"@Transactional\b", "SCOPE", 0.9),
            (r"@(?:Autowired|Bean|Component|Inject|Repository|Service)\b", "CONTRACT", 0.9), (r"@Before(?:All|Each)?\b", "INIT", 0.9), (r"@After(?:All|Each)?\b", "TEARDOWN", 0.9), (r"@EventListener\b", "SUBSCRIBE", 0.9),
        ),
        _bases("", "", "", "|ControllerBase", "|CanActivate(?:Child)?|CanDeactivate"), [("launch", "", "ASYNC", 0.85), ("async", "", "ASYNC", 0.85)], fold=True,
    ),
    "scala": Language(
        _heads(("b", r"\s*(?:[a-z]+\s+)*def\s+(\w+)(?=.*\{\s*$)"), ("i", r"\s*(?:[a-z]+\s+)*def\s+(\w+)")), _words(**{**_BRACED, "CONDITIONAL": "if match"}),
        {**_names("apply beforeAll beforeEach main setUp", "afterAll afterEach close destroy shutdown stop tearDown"), "receive": ("SUBSCRIBE", 0.95)},
        _calls(FETCH="findone findall findby", EMIT="next", SUBSCRIBE="addlistener", VALIDATE="assertvalid"), _words(LOG="logger log console", MEASURE=_METERS),
        bases=_bases("", "", "", "|ControllerBase", "|CanActivate(?:Child)?|CanDeactivate"), pairs=[("future", "", "ASYNC", 0.85), ("async", "", "ASYNC", 0.85)], fold=True,
    ),
    "c": Language(
        _heads(("b", rf"{_NOT}(?:[\w*]+\s+)+\*?(\w+)\s*\([^;]*\)\s*\{{?\s*$")), _words(OUTPUT="return", CONDITIONAL="if switch", LOOP="for while do"), {"main": ("INIT", 0.95)},
        _words(FETCH="malloc calloc realloc", TEARDOWN="free", LOG="printf fprintf sprintf", PERSIST="fclose fopen fread fwrite", TRANSFORM="memcpy memmove memset strcpy strncpy"), {}, test=("test", 0.9),
    ),
    "lua": Language(
        _heads(("e", r"\s*(?:local\s+)?function\s+(?:\w+[.:])*(\w+)\s*\("), ("e", r"\s*(?:local\s+)?(?:\w+\.)*(\w+)\s*=\s*function\s*\(")), _words(OUTPUT="return", CONDITIONAL="if", LOOP="for while repeat"),
        {**_names("create init new open setup start", "cleanup close destroy shutdown stop teardown", 0.9), **{n: ("MUTATE", 0.85) for n in ("update", "on_update", "tick")}},
        _words(RAISE="error assert", FETCH="require", RECOVER="pcall xpcall", LOG="print"), {}, pairs=[("wrap", "coroutine", "ASYNC", 0.75), ("create", "coroutine", "ASYNC", 0.75), ("write", "io", "LOG", 0.75)], test=("test", 0.9),
    ),
    "elixir": Language(
        _heads(("e", r"\s*defp?\s+(\w+)[!?]?(?=.*\bdo\s*$)")),
        _words(CONDITIONAL="case cond if unless with", LOOP="for", SUBSCRIBE="receive", RAISE="raise throw", RECOVER="rescue catch", DEFER="after"),
        {**_names("child_spec init on_mount setup setup_all start start_link", "terminate stop"), **{n: ("SUBSCRIBE", 0.95) for n in "handle_action handle_call handle_cast handle_continue handle_event handle_info".split()}},
        _words(FETCH="all fetch find get one query", PERSIST="create insert put save write", MUTATE="delete patch remove update", TRANSFORM="decode encode filter map parse reduce transform", EMIT="broadcast dispatch emit publish push", SUBSCRIBE="subscribe", VALIDATE="validate validate_changeset changeset", ASYNC="spawn spawn_link spawn_monitor"),
        {}, pairs=[("async", "Task", "ASYNC", 0.75), ("start", "Task", "ASYNC", 0.75), *((m, "GenServer", "DELEGATE", 0.75) for m in ("call", "cast")), *((m, "Logger", "LOG", 0.75) for m in ("info", "error", "debug")), *((m, "IO", "LOG", 0.75) for m in ("puts", "inspect"))],
        bases=[(re.compile(f"^{re.escape(b)}$"), t, 0.9) for b, t in (("GenServer", "SUBSCRIBE"), ("Phoenix.Controller", "ROUTE"), ("Phoenix.LiveView", "SUBSCRIBE"), ("Ecto.Schema", "CONTRACT"), ("ExUnit.Case", "TEST"), ("Agent", "SUBSCRIBE"), ("Task", "ASYNC"))],
    ),
}
#: Parts of a C name that tell a token.
C_PARTS = [("INIT", 0.9, "init initialize setup"), ("TEARDOWN", 0.9, "cleanup close destroy free shutdown teardown")]
