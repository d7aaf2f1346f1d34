"""Reserved words and native types by language, beyond the short lists in the registry; grouped by what they are for."""

from __future__ import annotations

_SH = "if then elif else fi case esac for in do done while until select function time return break continue exit export local readonly declare typeset unset shift trap eval exec source alias set let coproc"
_ML_LIKE = "let in if then else case of where module import type data"
_WIDTHS = "8 16 32 64"


def _sized(*stems: str) -> str:
    return " ".join(stem.replace("#", width) for stem in stems for width in _WIDTHS.split())


#: Keywords, then native types.
MORE = {
    "Agda": ("module where open import public using hiding renaming to data record field constructor inductive coinductive eta-equality no-eta-equality let in with rewrite do forall infix infixl infixr abstract private instance macro mutual postulate primitive syntax pattern variable overlap quote quoteTerm unquote unquoteDecl unquoteDef tactic opaque unfolding interleaved", "Set Prop Level Nat Bool String Char Float"),
    "Awk": ("BEGIN END BEGINFILE ENDFILE function func if else for while do in break continue next nextfile exit return delete switch case default getline print printf", "NR NF FS RS OFS ORS FNR FILENAME ARGC ARGV ENVIRON SUBSEP RSTART RLENGTH CONVFMT OFMT length substr index split sub gsub match sprintf tolower toupper sin cos atan2 exp log sqrt int rand srand system close fflush"),
    "Bash": (_SH + " mapfile shopt getopts pushd popd", "echo printf read test cd pwd kill wait umask true false"),
    "C": ("_Bool _Complex _Imaginary _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local alignas alignof static_assert thread_local constexpr nullptr typeof typeof_unqual", "ptrdiff_t wchar_t ssize_t off_t time_t FILE va_list intptr_t uintptr_t intmax_t uintmax_t void"),
    "Cpp": ("asm goto typeid static_cast dynamic_cast const_cast reinterpret_cast volatile extern register thread_local static_assert alignas alignof consteval constinit concept requires co_await co_return co_yield export import module and or not xor bitand bitor compl and_eq or_eq xor_eq not_eq signed unsigned", "char8_t string wstring vector map set list deque pair tuple optional variant int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t ptrdiff_t nullptr_t"),
    "CMake": ("if elseif else endif foreach endforeach while endwhile function endfunction macro endmacro block endblock return break continue set unset option include find_package find_library find_path find_program add_library add_executable add_subdirectory add_custom_command add_custom_target add_dependencies add_test add_definitions add_compile_options target_link_libraries target_include_directories target_compile_definitions target_compile_options target_sources project cmake_minimum_required message install list string file math configure_file get_property set_property set_target_properties AND OR NOT STREQUAL MATCHES EXISTS DEFINED VERSION_LESS VERSION_GREATER IN_LIST", "ON OFF TRUE FALSE STATIC SHARED MODULE PUBLIC PRIVATE INTERFACE REQUIRED"),
    "Cabal": ("name version synopsis description license author maintainer category build-type cabal-version executable library test-suite benchmark flag source-repository common if else elif import", "True False"),
    "Chapel": ("module use import only except proc iter operator lambda class record union enum interface implements owned shared borrowed unmanaged new init deinit delete this super private public export extern override inline param const var type ref out inout in config atomic single sync local locale on here begin cobegin coforall forall foreach for do while if then else select when otherwise break continue return yield label let where with reduce scan by align dmapped domain sparse subdomain index noinit nil none true false throw throws try catch defer serial require prototype", "int uint real imag complex bool string bytes void nothing range"),
    "Clojure": ("def defn defn- defmacro defmulti defmethod defprotocol defrecord deftype defonce definterface declare fn let letfn loop recur if if-not if-let when when-not when-let when-first cond condp case do doto doseq dotimes for while try catch finally throw quote var ns require use import refer and or not new set! -> ->> as-> some-> some->> with-open binding lazy-seq reify proxy extend-type extend-protocol", "nil true false map filter reduce apply vector list hash-map set first rest next cons conj assoc dissoc get get-in update str println"),
    "Coffee": ("if else unless then switch when for in of by while until loop do break continue return yield await try catch finally throw class extends super new delete typeof instanceof this and or not is isnt import export from default debugger", "true false null undefined yes no on off"),
    "Csharp": ("delegate event explicit implicit operator extern fixed lock unsafe stackalloc volatile params goto sizeof typeof nameof checked unchecked default when where select from let join group into orderby ascending descending by on equals get set add remove init value record required partial global dynamic with and or not file scoped notnull unmanaged managed", "nint nuint"),
    "Csh": ("if then else endif foreach end while switch case default breaksw endsw break continue goto onintr repeat exit shift alias unalias set unset setenv unsetenv source eval exec nohup time", "echo cd glob history"),
    "Css": ("important inherit initial unset revert auto none media import charset font-face keyframes supports namespace page layer container property from to and not only screen print all", "px em rem vh vw deg rad ms s rgb rgba hsl hsla url calc var"),
    "Cql": ("SELECT FROM WHERE AND IN LIMIT ORDER BY ASC DESC ALLOW FILTERING INSERT INTO VALUES IF NOT EXISTS USING TTL TIMESTAMP UPDATE SET DELETE TRUNCATE BEGIN BATCH APPLY UNLOGGED COUNTER CREATE ALTER DROP TABLE KEYSPACE COLUMNFAMILY INDEX MATERIALIZED VIEW TYPE FUNCTION AGGREGATE TRIGGER WITH PRIMARY KEY CLUSTERING STATIC ON USE GRANT REVOKE TO OF ROLE USER PASSWORD LOGIN SUPERUSER CONTAINS DISTINCT COUNT AS JSON TOKEN WRITETIME NULL", "ascii bigint blob boolean counter date decimal double duration float frozen inet int list map set smallint text time timestamp timeuuid tinyint tuple uuid varchar varint"),
    "D": ("asm body cast debug version delegate function deprecated extern export final finally goto inout invariant in out ref is lazy macro mixin nothrow override package pragma private protected public pure return scope shared static struct switch synchronized template typeid typeof with __gshared __traits __parameters assert abstract", "cent ucent cfloat cdouble creal ifloat idouble ireal dchar string wstring dstring size_t ptrdiff_t void"),
    "Dart": ("abstract assert covariant deferred dynamic export external factory Function get set hide show interface late on operator required rethrow return static sync typedef when yield sealed base", "List Map Set Object Iterable Future Stream Null Never void"),
    "Dhall": ("if then else let in using missing as merge toMap assert with forall", "Bool Natural Integer Double Text List Optional Type Kind Sort None True False Date Time TimeZone"),
    "Elixir": ("defstruct defprotocol defimpl defexception defdelegate defguard defguardp defmacrop defoverridable defcallback use import require alias quote unquote unquote_splicing super throw exit import in is_nil __MODULE__ __ENV__ __DIR__ __CALLER__ __STACKTRACE__", "is_atom is_binary is_boolean is_float is_function is_integer is_list is_map is_number is_pid is_tuple hd tl elem length"),
    "Elm": (_ML_LIKE + " as exposing port alias infix left right non effect command subscription", "Int Float Bool Char String List Maybe Result Cmd Sub Task Order True False Just Nothing Ok Err"),
    "Erlang": ("andalso orelse bnot bxor bsl bsr maybe else", "is_atom is_binary is_boolean is_float is_function is_integer is_list is_map is_number is_pid is_port is_reference is_tuple true false ok error undefined"),
    "Fish": ("if else end for in while switch case function begin and or not break continue return set command builtin test exec", "echo printf read string math status count contains source eval"),
    "Fortran": ("program end module submodule contains subroutine function procedure interface abstract use only implicit none integer real complex logical character type class extends allocatable pointer target dimension parameter intent in out inout optional save public private protected external intrinsic pure elemental recursive result entry call return if then else elseif endif select case default do while enddo cycle exit concurrent forall where elsewhere goto continue stop error allocate deallocate nullify read write print open close inquire format data common equivalence namelist block associate critical sync import bind value volatile asynchronous contiguous generic operator assignment final deferred", "INTEGER REAL COMPLEX LOGICAL CHARACTER"),
    "Fsharp": ("abstract assert base begin default delegate do downcast downto elif extern fixed global inherit inline interface internal lazy match! override private public select sig struct upcast use! val void when yield! let! return! of as const params process protected pure sealed tailcall trait virtual mod component constraint", "int8 int16 int32 int64 uint8 uint16 uint32 uint64 nativeint unativeint sbyte uint float32 single double bigint obj exn list seq array option decimal"),
    "Go": ("iota", "any comparable append cap clear close complex copy delete imag len make max min new panic print println real recover"),
    "Haskell": ("default family role pattern static stock anyclass via mdo rec proc forall foreign export ccall safe unsafe interruptible", _sized("Int#", "Word#") + " Rational Ordering Show Read Eq Ord Enum Bounded Num Functor Applicative Monad Monoid Semigroup Foldable Traversable FilePath True False Just Nothing Left Right"),
    "Html": ("", ""),
    "Idris": (_ML_LIKE + " with do total partial covering public export private implicit auto default using namespace mutual record constructor interface implementation parameters rewrite infix infixl infixr prefix postulate codata dsl syntax proof tactics impossible forall", "Type Nat Integer Int Double Char String Bool List Vect Maybe Either Void Unit True False"),
    "Java": ("goto record sealed permits non-sealed yield var module requires exports opens uses provides to with transitive when", "String Object Integer Long Short Byte Character Boolean Float Double Void"),
    "Javascript": ("enum implements interface package private protected public static abstract as declare from get set is keyof namespace readonly require infer type asserts satisfies override accessor unique global", "any boolean number string symbol bigint object unknown never Array Object Map Set Promise NaN Infinity"),
    "Julia": ("elseif where outer as do primitive type ccall new nothing missing", "Int128 UInt128 Float16 BigInt BigFloat Complex Rational Real Number Integer AbstractFloat Any Nothing Missing Symbol Array Vector Matrix Dict Set Tuple"),
    "Kotlin": ("actual annotation by crossinline delegate dynamic expect external field file get infix init inline inner noinline operator out param property receiver reified set setparam suspend tailrec value where it", "Array List Map Set Nothing Number UInt ULong UShort UByte"),
    "Ksh": (_SH + " print whence nameref", "echo printf read test cd pwd kill wait umask true false integer float"),
    "Lisp": ("defun defmacro defvar defparameter defconstant defstruct defclass defmethod defgeneric defpackage deftype define-condition in-package lambda let let* flet labels macrolet symbol-macrolet if when unless cond case ecase typecase etypecase progn prog1 prog2 block return return-from tagbody go loop do do* dolist dotimes setq setf psetf incf decf push pop quote function funcall apply multiple-value-bind multiple-value-setq destructuring-bind unwind-protect catch throw handler-case handler-bind restart-case declare declaim the eval-when and or not", "nil t car cdr cons list append mapcar mapc reduce length nth first rest null atom eq eql equal"),
    "Lua": ("", "assert collectgarbage dofile error getmetatable ipairs load loadfile next pairs pcall print rawequal rawget rawlen rawset require select setmetatable tonumber tostring type xpcall _G _VERSION self"),
    "Make": ("ifeq ifneq ifdef ifndef else endif include sinclude -include define endef undefine override export unexport private vpath", "subst patsubst strip findstring filter filter-out sort word wordlist words firstword lastword dir notdir suffix basename addsuffix addprefix join wildcard realpath abspath foreach call value eval origin flavor shell error warning info"),
    "Nim": ("", "uint uint8 uint16 uint32 uint64 float float32 float64 bool char string cstring pointer seq array set tuple range openArray varargs untyped typed void auto any true false"),
    "OCaml": ("effect", "bytes int32 int64 nativeint exn ref result lazy_t format Some None Ok Error"),
    "ObjectiveC": ("class protocol optional required public private protected package selector encode synchronized autoreleasepool try catch finally throw dynamic compatibility_alias defs end in out inout byref bycopy oneway nonatomic atomic strong weak copy assign retain readonly readwrite getter setter typedef struct enum union static extern const volatile sizeof goto inline register unsigned signed auto instancetype nullable nonnull __block __weak __strong __bridge YES NO", "NSString NSInteger NSUInteger NSArray NSDictionary NSObject NSNumber NSSet NSData NSError CGFloat SEL IMP Class size_t bool"),
    "PHP": ("die exit eval include_once require_once insteadof goto enddeclare endfor endforeach endif endswitch endwhile enum match readonly self parent finally from never __CLASS__ __DIR__ __FILE__ __FUNCTION__ __LINE__ __METHOD__ __NAMESPACE__ __TRAIT__ __halt_compiler", "int float bool string object iterable mixed void resource"),
    "Perl": ("if elsif else unless while until for foreach do last next redo goto return sub my our local state package use no require BEGIN END INIT CHECK UNITCHECK and or not xor eq ne lt gt le ge cmp x qw q qq qr tr y s m given when default say die warn eval defined undef ref bless wantarray __PACKAGE__ __FILE__ __LINE__ __DATA__ __END__", "print printf push pop shift unshift splice keys values each delete exists join split map grep sort reverse length substr index open close chomp chop sprintf"),
    "ProtoBuf": ("syntax edition import weak public package option message enum service rpc returns stream oneof map reserved extensions extend optional required repeated to max group true false", "double float bool string bytes int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64 sfixed32 sfixed64"),
    "Python": ("match case type _ self cls __init__ __name__", "int float complex str bytes bytearray bool list tuple dict set frozenset object range memoryview slice type property"),
    "R": ("return library require source NA_integer_ NA_real_ NA_complex_ NA_character_ invisible stop warning tryCatch switch", "integer numeric double complex character logical raw list vector matrix array factor"),
    "Ruby": ("BEGIN END __ENCODING__ __FILE__ __LINE__ __method__ require require_relative include extend prepend attr attr_reader attr_writer attr_accessor private protected public raise loop lambda proc puts catch throw", "Integer Float String Symbol Array Hash Range NilClass TrueClass FalseClass Object"),
    "Rust": ("abstract become box do final macro override priv try typeof unsized virtual yield union auto default macro_rules raw", "String Vec Option Result Box Rc Arc Some None Ok Err HashMap HashSet f16 f128"),
    "Scala": ("given using enum export then end extension inline opaque open transparent derives infix as", "Array List Map Set Seq Option Some None Either Left Right Nothing Null AnyRef AnyVal BigInt BigDecimal"),
    "SmallTalk": ("self super thisContext ifTrue ifFalse whileTrue whileFalse timesRepeat to do by subclass instanceVariableNames classVariableNames package new yourself", "nil true false Object Integer String Array Dictionary Set OrderedCollection Transcript Symbol Character Float"),
    "Sql": ("full cross natural using intersect except fetch offset rows only first next with recursive over partition window range preceding following unbounded current row grant revoke commit rollback savepoint begin transaction trigger procedure function returns return declare cursor loop while if elseif cast coalesce nullif asc desc default check constraint unique cascade restrict temporary truncate merge matched lateral any some true false FULL CROSS NATURAL USING INTERSECT EXCEPT FETCH OFFSET ROWS ONLY FIRST NEXT WITH RECURSIVE OVER PARTITION WINDOW RANGE GRANT REVOKE COMMIT ROLLBACK BEGIN TRANSACTION TRIGGER PROCEDURE FUNCTION RETURNS RETURN DECLARE CURSOR CAST COALESCE ASC DESC DEFAULT CHECK CONSTRAINT UNIQUE CASCADE TRUNCATE MERGE LATERAL TRUE FALSE", "int integer smallint bigint tinyint decimal numeric real double float char varchar nchar nvarchar text clob blob date time timestamp interval boolean binary varbinary INT INTEGER SMALLINT BIGINT DECIMAL NUMERIC REAL DOUBLE FLOAT CHAR VARCHAR TEXT DATE TIME TIMESTAMP BOOLEAN"),
    "Swift": ("actor any async await consume convenience didSet distributed dynamic final get indirect infix isolated lazy left mutating none nonisolated nonmutating optional override postfix precedence prefix Protocol required right set some Type unowned weak willSet Self Any borrowing consuming macro package", _sized("UInt#") + " Int128 Character String Array Dictionary Set Optional Void Never AnyObject"),
    "Tcl": ("proc return if then else elseif for foreach while switch break continue set unset global variable upvar uplevel namespace package require provide source eval expr catch error throw try on trap finally apply coroutine yield tailcall rename interp", "append array concat dict incr info join lappend lindex linsert list llength lrange lreplace lsearch lset lsort puts gets read open close format scan regexp regsub split string subst trace vwait after"),
    "Unison": (_ML_LIKE + " ability structural unique handle with do cases match use namespace forall termLink typeLink alias rewrite", "Nat Int Float Boolean Char Text Bytes Optional List true false"),
    "VHDL": ("entity architecture of is begin end port generic map component configuration package body library use all signal variable constant file shared type subtype record array range to downto others process procedural function procedure return pure impure if then elsif else case when select with loop for while next exit wait until on after report assert severity generate block guarded bus register disconnect attribute alias group label literal units access new null open in out inout buffer linkage transport inertial reject unaffected postponed protected context force release default and or not nand nor xor xnor mod rem abs sll srl sla sra rol ror", "bit bit_vector boolean character integer natural positive real string time std_logic std_logic_vector std_ulogic std_ulogic_vector signed unsigned severity_level"),
    "Verilog": ("module endmodule macromodule primitive endprimitive interface endinterface package endpackage program endprogram class endclass extends implements virtual modport import export input output inout ref parameter localparam defparam specparam assign deassign force release always always_comb always_ff always_latch initial final begin end fork join join_any join_none if else case casex casez endcase default for foreach while do repeat forever break continue return disable wait posedge negedge edge function endfunction task endtask generate endgenerate genvar specify endspecify table endtable assert assume cover property endproperty sequence endsequence clocking endclocking covergroup endgroup coverpoint constraint rand randc randcase unique priority typedef struct union enum packed static automatic const void new this super null signed unsigned and or not nand nor xor xnor buf bufif0 bufif1 notif0 notif1 pullup pulldown cmos nmos pmos tran supply0 supply1 strong0 strong1 pull0 pull1 weak0 weak1 highz0 highz1 small medium large scalared vectored", "wire wand wor tri triand trior tri0 tri1 trireg reg logic bit byte shortint int longint integer time real realtime shortreal string event chandle"),
    "Zig": ("callconv linksection opaque asm unreachable anyframe nosuspend", "i128 u128 f16 f80 f128 c_char c_short c_ushort c_int c_uint c_long c_ulong c_longlong c_ulonglong c_longdouble comptime_int comptime_float anyerror anyopaque noreturn"),
    "Zsh": (_SH + " foreach end repeat autoload zmodload zstyle bindkey setopt unsetopt emulate nocorrect noglob", "echo print printf read test cd pwd kill wait umask true false integer float"),
}
