"""Frequent words of identifiers, commonest first (from half of the Python standard library's files)."""

from __future__ import annotations

WORDS = (
    "test with error name type tests file from check class path module list dict default exception base case read assert string unicode "
    "load value patma create invalid header write call handler format mock data text empty issue method line object spec bytes args "
    "async long func size context expected subclass function close make event info decode tuple timeout server encode init start repr "
    "import equal source config code socket result buffer open names task version parse message copy errors enum types multiple return "
    "handle only attribute after item count proxy send thread hash callback generic protocol encoding queue local frame loop lines time "
    "custom python child builtin cache other keys mapping match traceback simple wait nested frozen none float content clear level "
    "callable exit user attr missing loader address pickle stack recv sequence index node raise basic windows future flags input alias "
    "find package process parser stream flag generator filename global pattern help patch state methods mode visit pipe cleanup single "
    "iter filter syntax mixin length orig group array values instance params field left skip zero relative manager binary last remove "
    "offset current without called down ascii connection register double print ignore self char addr failure main right raises sock "
    "client common helper cancel output calls named extra files memory prefix update delete request trace parent stmt first complex "
    "union save recvmsg property number lock next sample limit attributes reader some weak order element same into charset param "
    "shutdown namespace keyword table space attrs cmsg items convert body link factory compare memoryview auto http resource dump split "
    "before root reset wrapper setup stop true command debug constructor does replace null script unknown fields slots escape fork "
    "abstract modules trunc date defaults false verify warning exec extension headers target compile short kwargs window enter struct "
    "original except mixed star fail deepcopy connect inner collect iterator repeat quote exceptions recursive move flush symlink "
    "descriptor large shared complete closed bound document signature full vars indent inheritance locale broken entry have grid meth "
    "configure color logger temp override block special datetime posix recursion byte multi overflow bases cert wrong multipart valid "
    "coroutine docstring console system sendmsg when stderr option negative blocking stdout hook show explicit tree symlinks many "
    "asyncio build lineno slice transport access auth side autospec proto small expr location requires fake threads append writer bool "
    "plain range view runtime join annotations real status unpack vector defect partial arrow buffered second this caret directory "
    "dataclass encoded constant magic release suite browser hints found weakref coro protocols alert registry allow part done html "
    "response dummy wrap bytecode formatter unix parts effect channel eval clean getitem menu worker meta perf description chars events "
    "latin contains members ndarray accept certificate existing newline select unbound support children difference duplicate host safe "
    "huge digest bind multiline decimal supports running network testfunc port operator wrapped width entity handshake lookup varargs "
    "dialog reference policy cached record super sort codec taskgroup round font stats member doctest subprocess pool pack random "
    "reduce section character dispatch fast plus should jump glob reading change cases post comp dont signed implicit query reverse "
    "interrupted over expect fallback static saved using failed parameter different once payload point pending token globals pylong "
    "archive push refs classmethod interpreter resolve good free enabled outer selector finder correct iterable theme await boundary "
    "builtins final screen remote normal positional returns derived unsigned comment classes pass sendfile ordered break isinstance "
    "paths forward cursor exists writing retry cannot locals objects word more optional literal json whitespace button insert threading "
    "rmtree strict watcher zone absolute cycle keywords warn datagram checked functions executor unregister place getattr warnings "
    "suffix regex redirect history idle unique rollover options mutation decorator readline total unsupported allowed bytearray pure "
    "exact continue tlsv counter clone changed search strip trailing greater quoted cancelled uint patterns inherit walk less usage "
    "chain ready legacy disabled spam arguments instantiation frames logging scope internal threaded spaces readonly actual prepare "
    "subclasses equality page lambda during results integer approx step anext extended stat exist listener epoch annotation work "
    "display pydoc suggestions supported argument hamt pickler native seek ignored frac tasks comparison chunk literals contextmanager "
    "external transform expression winfo inline incremental mark sign stdin ensure aggr deadlock fill makefile private until handling "
    "interp action breakpoint finalize extensions subset depth origin title template sqlite sizeof constants extract unreachable gzip "
    "inst normalize interpreters crash fatal variable annotated required scoped sets compat then interface blake iobase condition "
    "getter proactor padding parameters timer assign openssl anchor trans tear enable netmask sendto validate both metadata active "
    "example shell deep style collision nonascii decl yield grammar handlers unnamed quopri roundtrip unhashable runner mtime family "
    "force division platform keyed pickling fails calc tracker callbacks interrupt hostname suppress like high tilde store iteration "
    "turtle stateful generate zipfile shift strings available hello capture bits staticmethod reraise vectorcall misc continuation "
    "creation progress separator drive https sync decoder numeric attach prev debugger environment completed compute control spawn diff "
    "selection autocommit subclassing snapshot slot mutating works label overlap library codecs deprecated binding details leaf domain "
    "prompt conn sleep already setitem dist mask contiguous overridden notify mime pprint dunder ranges unused digits previous keep "
    "destroy square temporary month received variadic fffffffffffff unpickle processing proc heap decodeutf known times issubclass "
    "scheme unexpected isolation rule success structure include quotes here pointer created parsedate setstate venv mutable valued "
    "writes const maybe matches disable modified realpath interactive stdlib feature writable very raising compiled fdpass nodes used "
    "report never expand incomplete half intersection lost formatting aware initial leading pair signal reload imports standard environ "
    "finally virtual merge fixed weird curdir undo session sqrt suggestion lazy ints profile dialect illegal pathlike barrier compress "
    "week namedtuple immutable sentinel lists groups timestamp readinto dealloc follow minus regression aliases typevar importlib "
    "elements impl localtime while resize nonlocal delay messages tzpath terminal dotted widget assignment ffff subscript hmac gather "
    "uses limits reuse toggle back edit delegator year android inherited shape capi keymap properties raised semaphore watchers twice "
    "finish copytree certfile aclose verbose substitution examples popen ordering deleted added compiler exactly replacement cpython "
    "acquire colors soft workers superset unary seconds edge itself entries unittest decoded public trampoline digit statement "
    "metaclass cast form unquote quoting deprecation inside suffixes apply specialization encoder core hide height dirs closing wraps "
    "escaped doctype days resume kcqk wchar editor identity fileno regular email subtype endian wave another always device typevartuple "
    "highlight basics captured sslv asutf wildcard closure poll later linux definition foreign instruction hardlink operations catch "
    "sendrecvmsg docstrings operation recurse characters guess zlib delitem bypass eager succeeds iters install starred recvfrom "
    "operators lower setting points ancillary loaded traces numbers deque mutate throw unpickler assigned unassigned startup aligned "
    "racing returned reserved home waiter testfile packed upper must cdata copying site handles undefined completion plist ssize "
    "circular nowait cause demo parsing translate fstring skipped interpolation annot hint submodule shield dash pause priority failing "
    "unlink preferred kernel wide idempotent triangle collation infer else category something getstate ending maxlinelen slow cell "
    "click peek formats even sorted excepthook noargs checks three naive restart distribution seen bracket resources owner database "
    "rate zoneinfo makes remaining track nonexistent positions reversed mocks sourceless through minimal need tuples finished argv "
    "limited dynamic adapter image repeated ciphers misuse connected evil precedence race fragment instances modes asdict testfn "
    "disposition column swap note transition require memo rules atomic extend comprehension athrow floats "
).split()
