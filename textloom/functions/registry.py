"""What the engine knows of languages: selectors, kind, delimiters, identifier letters, keywords.

A row of LANGUAGES reads ``type ¦ kind ¦ selectors ¦ comments ¦ strings ¦ raw
strings ¦ characters ¦ identifiers``.  Selectors: ``.x`` an extension, ``+.x`` a
header's, others whole file names.  Delimiters: pairs ``begin end`` joined by
``~``, several by blanks; ``NL`` ends at the line's end.  The registry is data:
``with_language`` adds or replaces rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from textloom.functions.keywords import MORE

LETTER, ALNUM = "A-Za-z", "A-Za-z0-9"
#: Identifier letters (start, continue) as insides of character classes.
CHARSETS = {
    "ascii_": (f"{LETTER}_", f"{ALNUM}_"),
    "ascii": (LETTER, f"{ALNUM}_"),
    "ascii'": (f"{LETTER}_", f"{ALNUM}_'"),
    "cmake": (f"{LETTER}_", f"{ALNUM}_\\-"),
    "dash": (f"{LETTER}_\\-", f"{ALNUM}_\\-"),
    "uni_": (r"\p{L}_", r"\p{L}\p{Nd}_"),
    "uni'": (r"\p{L}_", r"\p{L}\p{Nd}_'"),
    "uni$": (r"\p{L}_", r"\p{L}\p{Nd}_$"),
    "coffee": (r"\p{L}\p{Nd}_'", r"\p{L}\p{Nd}_$"),
    "java": (r"\p{L}_$", r"\p{L}\p{Nd}_$"),
    "csharp": (r"\p{L}\p{Nl}_@", r"\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\p{Cf}"),
    "xid": (r"\p{L}\p{Nl}_", r"\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}"),
    "julia": (r"\p{L}_", r"\p{L}\p{Nd}_!?"),
    "html": (LETTER, f"{ALNUM}_.:\\-"),
    "clojure": (r"^\x00-\x20\xA0()\[\]{}@;~`\"'\\,#:0-9", r"^\x00-\x20\xA0()\[\]{}@;~`\"'\\,"),
    "lisp": (r"a-z!$%&*+\-./:<=>?@^_~", r"a-z0-9!$%&*+\-./:<=>?@^_~"),
    "agda": (r"^\x00-\x20\xA0@.(){};_\"0-9", r"^\x00-\x20\xA0@.(){};_\""),
}

LANGUAGES = r"""
Agda ¦ Language ¦ .agda .lagda ¦ {-~-} --~NL ¦ "~" ¦  ¦ '~' ¦ agda
Assembly ¦ Language ¦ .s .S .asm .ASM ¦ #~NL ;~NL |~NL !~NL /*~*/ ¦ "~" ¦  ¦  ¦
Awk ¦ Script ¦ .awk .mawk .gawk ¦ {-~-} --~NL #~NL ¦ "~" ¦  ¦  ¦ ascii_
Bash ¦ Script ¦ .sh .bash ¦ #~NL ¦ '~' "~" ¦  ¦  ¦ ascii_
C ¦ Language ¦ .c .C +.inc ¦ /*~*/ //~NL ¦ "~" ¦ R"~" ¦ '~' ¦ ascii_
Cpp ¦ Language ¦ .cpp .CPP .cxx .cc .cp .c++ .cu .cuh +.tcc +.h +.H +.hpp +.ipp +.HPP +.hxx +.hh +.hp +.h++ ¦ /*~*/ //~NL ¦ "~" ¦ R"(~)" R"-(~)-" R"--(~)--" ¦ '~' ¦ ascii_
CMake ¦ Script ¦ CMakeLists.txt .cmake ¦ #~NL ¦ "~" ¦  ¦ '~' ¦ cmake
Cabal ¦ Config ¦ .cabal ¦ --~NL ¦ "~" ¦  ¦  ¦ uni'
Chapel ¦ Language ¦ .chpl ¦ /*~*/ //~NL ¦ "~" '~' ¦ \"""~\""" '''~''' ¦  ¦ uni$
Clojure ¦ Language ¦ .clj .cljs .cljc .edn ¦ ;~NL ;;~NL ;;;~NL ¦ "~" ¦  ¦  ¦ clojure
Coffee ¦ Script ¦ .coffee ¦ #~NL ###~### ¦ '~' "~" ¦ '''~''' \"""~\""" ¦  ¦ coffee
Conf ¦ Config ¦ .config .conf .cfg .doxy ¦ #~NL ¦ '~' "~" ¦  ¦  ¦
Csharp ¦ Language ¦ .cs .CS ¦ /*~*/ //~NL ¦ "~" ¦ \"""~\""" ¦ '~' ¦ csharp
Csh ¦ Script ¦ .csh .tcsh ¦ #~NL ¦ '~' "~" ¦  ¦  ¦ ascii
Css ¦ Markup ¦ .css ¦ /*~*/ ¦ "~" ¦  ¦  ¦ dash
Cql ¦ Language ¦ .cql ¦ --~NL ¦ '~' ¦  ¦  ¦ ascii_
D ¦ Language ¦ .d .D +.di ¦ /*~*/ //~NL ¦ "~" ¦ r"~" `~` ¦ '~' ¦ uni_
Dart ¦ Language ¦ .dart ¦ /*~*/ //~NL ¦ "~" '~' ¦ '''~''' \"""~\""" ¦  ¦ uni_
Dhall ¦ Config ¦ .dhall ¦ {-~-} --~NL ¦ "~" ¦  ¦  ¦ uni'
Elixir ¦ Language ¦ .ex .exs ¦ #~NL ¦ "~" '~' ¦  ¦  ¦ uni_
Elm ¦ Language ¦ .elm ¦ {-~-} --~NL ¦ "~" ¦ \"""~\""" ¦ '~' ¦ ascii'
Erlang ¦ Language ¦ .erl .ERL .hrl .HRL ¦ %~NL ¦ "~" ¦  ¦  ¦ ascii_
Fish ¦ Script ¦ .fish ¦ #~NL ¦ '~' "~" ¦  ¦  ¦ ascii_
Fortran ¦ Language ¦ .f .for .ftn .F .FOR .FTN .fpp .FPP .f90 .f95 .f03 .f08 .F90 .F95 .F03 .F08 ¦ !~NL ¦ "~" '~' ¦  ¦  ¦ ascii
Fsharp ¦ Language ¦ .fs .fsx .fsi ¦ (*~*) //~NL ¦ "~" ¦ \"""~\""" ¦ '~' ¦ uni'
Go ¦ Language ¦ .go ¦ /*~*/ //~NL ¦ "~" ¦ `~` ¦ '~' ¦ xid
GoMod ¦ Config ¦ go.mod ¦ //~NL ¦ "~" ¦  ¦  ¦
Haskell ¦ Language ¦ .hs .lhs .hsc ¦ {-~-} --~NL ¦ "~" ¦ [r|~|] [q|~|] [s|~|] [here|~|] [i|~|] ¦ '~' ¦ uni'
Html ¦ Markup ¦ .htm .html ¦ <!--~--> ¦ "~" ¦  ¦  ¦ html
Idris ¦ Language ¦ .idr .lidr ¦ {-~-} --~NL |||~NL ¦ "~" ¦  ¦ '~' ¦ ascii'
Java ¦ Language ¦ .java ¦ /*~*/ //~NL ¦ "~" ¦  ¦ '~' ¦ java
Javascript ¦ Language ¦ .js .ts .tsx ¦ /*~*/ //~NL ¦ "~" ¦  ¦ '~' ¦ java
Json ¦ Data ¦ .json .ndjson ¦  ¦ "~" ¦  ¦  ¦
Julia ¦ Language ¦ .jl ¦ #~NL #-~-# ¦ "~" ¦ \"""~\""" ¦ '~' ¦ julia
Kotlin ¦ Language ¦ .kt .kts .ktm ¦ /*~*/ //~NL ¦ "~" ¦ \"""~\""" ¦ '~' ¦ uni_
Ksh ¦ Script ¦ .ksh ¦ #~NL ¦ '~' "~" ¦  ¦  ¦ ascii_
Latex ¦ Markup ¦ .latex .tex ¦ %~NL ¦ "~" ¦  ¦  ¦
Lisp ¦ Language ¦ .lisp .cl ¦ ;~NL #|~|# ¦ "~" ¦  ¦  ¦ lisp
Lua ¦ Language ¦ .lua ¦ --[[~--]] --~NL ¦ '~' "~" ¦ [===[~]===] [==[~]==] [=[~]=] [[~]] ¦  ¦ uni_
Make ¦ Script ¦ Makefile makefile GNUmakefile .mk .mak .make ¦ #~NL ¦ '~' "~" ¦  ¦  ¦ dash
Nmap ¦ Script ¦ .nse ¦ --~NL [[~]] ¦ '~' "~" ¦  ¦  ¦
Nim ¦ Language ¦ .nim ¦ #[~]# #~NL ¦ "~" ¦ \"""~\""" ¦ '~' ¦ uni_
OCaml ¦ Language ¦ .ml +.mli ¦ (*~*) ¦ "~" ¦ {id|~|id} ¦ '~' ¦ ascii'
ObjectiveC ¦ Language ¦ .m .mi ¦ /*~*/ //~NL ¦ "~" ¦  ¦ '~' ¦ uni_
PHP ¦ Script ¦ .php .php3 .php4 .php5 .phtml ¦ /*~*/ //~NL #~NL ¦ '~' "~" ¦ <<END~END; <<'END'~END; ¦ '~' ¦ uni_
Perl ¦ Script ¦ .pl .pm .pm6 .plx .perl .t ¦ =pod~=cut #~NL ¦ '~' "~" ¦ <<"END";~END <<'END'~END <<'EOT';~EOT <<"EOT";~EOT ¦  ¦ ascii_
Python ¦ Language ¦ .py .pyx .pxd .pxi .scons ¦ #~NL ¦ '~' "~" ¦ \"""~\""" '''~''' r'~' ¦  ¦ uni_
ProtoBuf ¦ Language ¦ .proto ¦ //~NL /*~*/ ¦ "~" '~' ¦  ¦  ¦ uni_
R ¦ Language ¦ .r .R .rdata .rds .rda ¦ #~NL ¦ "~" '~' ¦  ¦  ¦ uni_
Ruby ¦ Language ¦ .rb .ruby ¦ =begin~=end #~NL ¦ '~' "~" %|~| %q(~) %Q(~) ¦  ¦ '~' ¦ uni_
Rust ¦ Language ¦ .rs ¦ /*~*/ //~NL ¦ "~" ¦ r##"~"## r#"~"# r"~" ¦ '~' ¦ xid
Scala ¦ Language ¦ .scala ¦ /*~*/ //~NL ¦ "~" '~' ¦  ¦ '~' ¦ uni_
SmallTalk ¦ Language ¦ .st .gst ¦ "~" ¦ '~' ¦  ¦  ¦ uni_
Swift ¦ Language ¦ .swift ¦ /*~*/ //~NL ¦ "~" ¦ \"""~\""" ¦  ¦ uni_
Sql ¦ Language ¦ .sql ¦ --~NL ¦ '~' ¦  ¦  ¦ ascii_
Tcl ¦ Script ¦ .tcl .tk ¦ #~NL ¦ "~" ¦  ¦  ¦ uni_
Text ¦ Text ¦ .txt .md .markdown .mdown .mkdn .mkd .mdwn .mdtxt .mdtext .text README INSTALL VERSION LICENSE AUTHORS CHANGELOG go.sum ¦  ¦  ¦  ¦  ¦
Unison ¦ Language ¦ .u ¦ {-~-} --~NL ¦ "~" \"""~\""" ¦  ¦ '~' ¦ ascii'
VHDL ¦ Language ¦ .vhd .vhdl ¦ --~NL ¦ "~" ¦  ¦ '~' ¦ ascii
Verilog ¦ Language ¦ .v .vh .sv ¦ /*~*/ //~NL ¦ "~" ¦  ¦  ¦ ascii_
Yaml ¦ Config ¦ .yaml .yml ¦ #~NL ¦ "~" '~' ¦  ¦  ¦
Toml ¦ Config ¦ .toml Cargo.lock ¦ #~NL ¦ "~" \"""~\""" ¦ '~' '''~''' ¦  ¦
Ini ¦ Config ¦ .ini ¦ ;~NL #~NL ¦ "~" ¦  ¦  ¦
Zig ¦ Language ¦ .zig ¦ //~NL ¦ "~" ¦ \\~NL ¦ '~' ¦ ascii_
Zsh ¦ Script ¦ .zsh ¦ #~NL ¦ '~' "~" ¦  ¦  ¦ ascii_
"""

_C_LIKE = "if else for while do switch case default break continue return"
#: Keywords, then native types.
KEYWORDS = {
    "C": (f"{_C_LIKE} goto sizeof typedef struct union enum static extern const volatile register auto inline restrict signed unsigned void", "int short long float double char bool size_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t"),
    "Cpp": (f"{_C_LIKE} class struct union enum namespace using template typename public private protected virtual override final static const constexpr mutable new delete this operator friend try catch throw noexcept nullptr auto decltype explicit inline true false void sizeof typedef", "int short long float double char bool wchar_t char16_t char32_t size_t"),
    "Csharp": (f"{_C_LIKE} class struct interface enum namespace using public private protected internal static readonly const new this base virtual override abstract sealed async await try catch finally throw var void null true false in out ref foreach yield is as", "int uint long ulong short ushort byte sbyte float double decimal char bool string object"),
    "D": (f"{_C_LIKE} class struct union enum interface import module unittest foreach auto const immutable new this super try catch finally throw template alias void true false null", "int uint long ulong short ushort byte ubyte float double real char wchar dchar bool"),
    "Dart": (f"{_C_LIKE} class enum extends implements with mixin import library part final const var void new this super async await try catch finally throw null true false in is as", "int double num bool String"),
    "Elixir": ("def defp defmodule defmacro do end fn if else case cond when unless for with receive after rescue raise try catch true false nil in and or not", ""),
    "Erlang": ("after begin case catch cond end fun if let of query receive try when and or not xor div rem band bor", ""),
    "Fsharp": ("let in if then else match with fun function type module namespace open rec mutable member static class end do for to while try finally exception raise new null true false and or not use yield return async", "int float string bool unit char byte decimal"),
    "Go": ("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false", "bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr"),
    "Haskell": ("case class data default deriving do else foreign if import in infix infixl infixr instance let module newtype of then type where forall qualified hiding as", "Int Integer Float Double Char String Bool Maybe Either IO Word"),
    "Java": (f"{_C_LIKE} abstract assert catch class enum extends final finally implements import instanceof interface native new package private protected public static strictfp super synchronized this throw throws transient try void volatile true false null", "boolean byte char double float int long short"),
    "Javascript": (f"{_C_LIKE} async await catch class const debugger delete export extends finally function import in instanceof let new of super this throw try typeof var void with yield null true false undefined", ""),
    "Julia": ("abstract baremodule begin break catch const continue do else elseif end export false finally for function global if import let local macro module mutable quote return struct true try using while in isa", "Int Int8 Int16 Int32 Int64 UInt8 UInt16 UInt32 UInt64 Float32 Float64 Bool Char String"),
    "Kotlin": ("as break by catch class companion constructor continue data do else enum false finally for fun if import in interface internal is lateinit null object open override package private protected public return sealed super suspend this throw true try typealias val var vararg when while", "Int Long Short Byte Float Double Boolean Char String Unit Any"),
    "Lua": ("and break do else elseif end false for function goto if in local nil not or repeat return then true until while", ""),
    "Nim": ("addr and as asm bind block break case cast concept const continue converter defer discard distinct div do elif else end enum except export finally for from func if import in include interface is isnot iterator let macro method mixin mod nil not notin object of or out proc ptr raise ref return shl shr static template try tuple type using var when while xor yield", "int int8 int16 int32 int64 uint float float32 float64 bool char string"),
    "OCaml": ("and as assert begin class constraint do done downto else end exception external false for fun function functor if in include inherit initializer lazy let match method module mutable new nonrec object of open or private rec sig struct then to true try type val virtual when while with", "int float bool char string unit list option array"),
    "ObjectiveC": (f"{_C_LIKE} id self super nil interface implementation end property synthesize protocol import", "int long short char float double BOOL void"),
    "PHP": (f"{_C_LIKE} abstract and array as callable catch class clone const declare echo elseif empty extends final finally fn foreach function global implements include instanceof interface isset list namespace new or print private protected public require static throw trait try unset use var xor yield null true false", ""),
    "Python": ("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield", ""),
    "R": ("if else repeat while function for in next break TRUE FALSE NULL Inf NaN NA", ""),
    "Ruby": ("alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield", ""),
    "Rust": ("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while", "bool char f32 f64 i8 i16 i32 i64 i128 isize str u8 u16 u32 u64 u128 usize"),
    "Scala": ("abstract case catch class def do else extends false final finally for forSome if implicit import lazy match new null object override package private protected return sealed super this throw trait try true type val var while with yield", "Int Long Short Byte Float Double Boolean Char String Unit Any"),
    "Sql": ("select from where and or not null insert into values update set delete create table drop alter join left right inner outer on group by having order limit union all distinct as case when then else end exists in is like between primary key foreign references index view SELECT FROM WHERE AND OR NOT NULL INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE DROP JOIN LEFT RIGHT INNER OUTER ON GROUP BY HAVING ORDER LIMIT UNION ALL DISTINCT AS CASE WHEN THEN ELSE END EXISTS IN IS LIKE BETWEEN", ""),
    "Swift": ("as associatedtype break case catch class continue default defer do else enum extension fallthrough false fileprivate for func guard if import in init inout internal is let nil open operator private protocol public repeat rethrows return self static struct subscript super switch throw throws true try typealias var where while", "Int Int8 Int16 Int32 Int64 UInt Float Double Bool Character String"),
    "Zig": ("addrspace align and anytype asm async await break catch comptime const continue defer else enum errdefer error export extern fn for if inline noalias null or orelse packed pub resume return struct suspend switch test threadlocal true try undefined union unreachable usingnamespace var volatile while false", "bool i8 u8 i16 u16 i32 u32 i64 u64 usize isize f32 f64 void type"),
    "Bash": ("if then else elif fi case esac for select while until do done in function time", ""),
}


@dataclass(frozen=True)
class Language:
    name: str
    kind: str
    names: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    headers: tuple[str, ...] = ()
    comments: tuple[tuple[str, str], ...] = ()
    strings: tuple[tuple[str, str], ...] = ()
    raws: tuple[tuple[str, str], ...] = ()
    chars: tuple[tuple[str, str], ...] = ()
    charset: str | None = None
    keywords: frozenset[str] = field(default=frozenset())
    natives: frozenset[str] = field(default=frozenset())


def _pairs(text: str) -> tuple[tuple[str, str], ...]:
    halves = (pair.replace('\\"', '"').split("~", 1) for pair in text.split())
    return tuple((a, "\n" if b == "NL" else b) for a, b in halves)


def _language(row: str) -> Language:
    name, kind, selectors, comments, strings, raws, chars, charset = (cell.strip() for cell in row.split("¦"))
    chosen = selectors.split()
    keywords, natives = (f"{a} {b}" for a, b in zip(KEYWORDS.get(name, ("", "")), MORE.get(name, ("", "")), strict=True))
    return Language(
        name,
        kind,
        tuple(s for s in chosen if s[0] not in ".+"),
        tuple(s for s in chosen if s[0] == "."),
        tuple(s[1:] for s in chosen if s[0] == "+"),
        _pairs(comments),
        _pairs(strings),
        _pairs(raws),
        _pairs(chars),
        charset or None,
        frozenset(keywords.split()) - frozenset(natives.split()),
        frozenset(natives.split()),
    )


REGISTRY: dict[str, Language] = {x.name: x for x in map(_language, LANGUAGES.strip().split("\n"))}
KINDS = ("Text", "Config", "Language", "Data", "Markup", "Script")


def with_language(language: Language, registry: dict[str, Language] = REGISTRY) -> dict[str, Language]:
    """A registry in which the language is added or replaced."""
    return registry | {language.name: language}
