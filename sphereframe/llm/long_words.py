"""English words of 8 to 14 letters that are frequent in technical prose, most frequent first: prose after a credential's name
is not a secret, and shorter words in one case never reach the default number of guesses."""

LONG_WORDS = """
function exception argument different instance returned functions following arguments specified implementation
multiple possible available contains otherwise character original reference specific attribute sequence directly
characters expected actually standard attributes provided subclass encoding containing behavior internal information
optional directory existing anything handling dictionary exceptions currently instances constructor defaults interface
previous parameter compatibility variable explicitly required something filename provides including override contents
necessary supported correctly trailing versions implemented additional relative returning checking supports requires
starting variables properly negative possibly probably interpreter operation creating equivalent appropriate
subclasses complete platforms callable generated underlying documentation elements arbitrary depending platform
messages separate behaviour corresponding representation position comparison protocol parameters operations
automatically environment descriptor iterable matching includes iterator extension absolute representing difference
followed implement considered generator particular whitespace expression everything according imported references
traceback backward converted statement explicit remaining namespace immediately specifies executed location algorithm
included supplied overridden conversion callback replaced beginning determine intended shutdown subprocess backwards
accepted compiled indicates modified definition important structure normally execution integers received dependent
registered positive temporary condition generate inherited connection associated extended formatted comparing
formatting separator constants resulting addition permission recursive represents compatible response collection
duplicate application suitable recursion sequences supporting reported assigned implements directories processing
therefore continue described previously iteration property creation disabled changing overflow represent identical
configuration determined semantics resource regardless indicate sometimes compiler together functionality specifying
software initialized executable unexpected performance purposes guaranteed examples docstring comments supposed
debugging triggered combinations indicating successful optimization interpreted blocking infinite positional silently
recursively readable conditions problems specification abstract copyright mechanism equality processes assignment
filesystem descriptors subsequent successfully unchanged printing terminated compared reserved register providing
properties alternative fallback internally produces children allowing consistent expressions independent implicit
interesting requests whenever interactive appended completion settings installed buffering resolution manually
comparisons statements selected filenames security readline component respectively signature encountered commands
warnings separated displayed processed database completely especially distribute controls decoding produced wrapping
keywords exercise presence packages typically modification occurred documented inserted newlines significant
combination recognized handlers regression failures implementing terminal finished ignoring identifier alternate
components addresses coroutine performed undefined optionally pickling consists applications incorrect guarantee
accessed deprecated encodings importing truncated repeated expanded decorator destroyed collected precision separators
threading terminate themselves relevant implicitly unittest configured requested metadata connected preceding
reasonable constructed executing operator individual consider contained decorated callbacks replacement boundary
obtained necessarily iterators features ordering immutable unsupported description extensions pathname circular
corresponds represented deleting potential operating consecutive attempts prevents introduced redundant dynamically
calculated preserved convenience preferred registry bytearray language resolved instantiation builtins consisting
literals assuming buffered sensible inheritance overrides indented selection external collections container preserve
validate generally segfault breaking brackets writable consistency maintain indentation computed released duplicates
importlib expressed priority whatever completed continuation overriding symbolic suppress referenced hashable slightly
accessible interfaces extracted partially rounding structures complicated machinery framework interrupted redirected
invocation succeeds efficient datetime unsigned compressed originally differences definitions detailed eventually
multiline password existent asynchronous temporarily remainder happened calculate consumed unnecessary incompatible
document inherits constant compliant optimized propagate validation construction separately transport printable
background insensitive searched unpacking symlinks overhead dispatch patterns dictionaries distinct containers
timestamp routines removing releases stripped retrieved connections replaces generators reliable designed operators
programs attached boundaries although exhausted defining docstrings sufficient occurrence division permissions
expensive deadlock describe invoking normalized hexadecimal undocumented generates mappings lowercase distribution
parentheses discarded identifying contexts concrete building repeatedly efficiently explanation timezone identify
counting coverage determines concatenation instruction metaclass attempted construct possibility practice prefixed
exponent involving affected retained meaningful initialize generating identity specifically sentinel populated
assertion regrtest initialization automatic recommended reporting searching destination overwrite similarly
finalization commonly normalization ambiguous triggers resources positions replacing converts universal detection
invariant preserves fractional appending controlled preceded interval surrogate backslash segments calculation
annotations identified retrieve reversed insertion differently sensitive allocation existence displays elsewhere
destructor correspond effective prefixes relatively precedence overwritten responsible identifiers incomplete bytecode
attempting pointing involved opposite converting algorithms arithmetic translation situations indicated protocols
appropriately anywhere occurrences recognize compound infinity workaround instantiated callables modifications
configure presented accessing generation clearing strictly subdirectories introspection dangling compression truncate
conditional specialized evaluated updating authentication indexing linecache skipping unspecified concurrent allocated
limitations particularly terminating compares assumptions normalize assumption requiring optimize potentially smallest
approach propagated distinguish situation simplest guarantees integral limitation combined executes verifies indicator
unregister tracebacks nonlocal responses spurious specially interpretation transfer substring deterministic entirely
singleton redirect unlikely cancelled defaulting describes bootstrap registering extending statistics canonical
interaction evaluates uncompressed distributed management thousands modifying concatenated yielding primarily
manipulation somewhere allocate convenient reproduce acceptable translate memoryview qualified instantiate convention
unpickling inconsistent malformed simplify direction reliably indirectly describing impossible fraction representable
initially template annotation functools recreate triggering accepting namespaces imaginary catching terminates
scheduled instantiating completes incorrectly vertical receiving coroutines threaded expecting machines iterated
installation rationale archives unavailable forbidden debugger libraries serialized abbreviated compilation knowledge
immediate producing resolving expansion dependency hierarchy suppressed preserving encounter finalizer applicable
exclusive translated signatures hostname advantage intentionally evaluate intermediate wrappers formatter selector
inheriting increase specifier classmethod roundtrip distinction delivered increment essentially somewhat adjacent
underscores geometry declared prepared subclassing randomly restored comprehension iterables flushing pertaining
delegate delimiter grouping modifier interpret contiguous backslashes notation simulate unmodified subtract interested
enclosing mutating effectively placeholder solution arbitrarily submodule parallel heuristic predicate persistent
portable enclosed transparent compliance sections horizontal unreachable declaration computing separating carefully
restriction alignment numerical confused shortcut deprecation discovered customized established verified discussion
iterating ourselves duplicated rejected scheduling anonymous constructs splitting capturing bindings parenthesis
underscore performing injection assigning technically cancellation buildbots exercises filtering sysconfig
subdirectory dependencies mentioned disables launching controlling preference introduce suffixes referring maintained
breakpoint breakpoints emulation category compiling highlight captured hardcoded calculating surrounding presentation
entering managers isinstance mismatch environments customization collector fractions ambiguity duration estimate
displaying requirement succeeded restores variations subclassed delimited superclass exported specifications practical
descriptions conventions accuracy ordinary advanced treatment paragraph stripping customize afterwards allowable
quotient permitted multiplication incremented unrelated functional tracking comprehensions performs notified
verification unhashable overwrites finishes increases bytestring connecting protection schedule conflict keyboard
uppercase combining datagram obsolete standalone correctness deallocated listening deliberately regarding cumulative
restrict filesystems isolated transformed substitutions respective readonly redefine stopping calendar finalized
locations desirable primitive fullname improved shorthand operates subtraction compress reachable identifies
asynchronously approximation disallow physical tokenizer weakrefs possibilities consequence advertising advancing
truncating incoming applying username delimiters adjusted ensuring wildcard descendant apparently computation coercion
overlapping magnitude occurring disallowed textwrap prepended disallows unbounded affecting constraints restrictions
infinities conversions switched efficiency operands registers shortest overwriting somebody filtered circumstances
decorators increasing reflected simplified discover instructions conjunction quadratic offending transform accurate
inspired semaphores semaphore recycled collecting serialization modifies acquiring insensitively augmented reasonably
directive confusion specifiers difficult flexible fragment oriented graphics coordinates milliseconds appearance
reflects annotated restoring recently completions interrupt receives rightmost communication interpreters complexity
optimizations rewritten chaining shifting understand subtypes production restricted refcount redirection refcounting
development pathnames basename minimize querying unaffected informative facility composite validity candidate managing
eliminating understood spelling basically concerned proceeds propagation architecture languages permutations bytecodes
stronger transition indefinitely daylight microseconds portions incremental reconstruct truncation decoders connects
timeouts preventing dispatched outermost complement frozenset authorization peephole delivery deletion enhanced
uniformly cleaning programming commented additions scanning distributions inclusive correction deviation substitution
semicolon recorded subnormal internals respects capability underflow floating excluding overflows maintaining
descendants nonexistent exclusively constructors backtracking introduces mandatory overview consuming processor
interprets unpickle establish inspection recognised traverse statically reaching certificate variants localhost
leftmost handshake initialised refcycle capacity denominator challenge sufficiently protected allocations datatype
certainly inserting movement developer referencing unrecognized erroneously canceled scrolled transformation selecting
complain picklable quotation problematic simplicity subscription subprocesses evaluation populate observed unescaped
retrieving repetition interest predictable bootstrapping serialize notification entities assertions testcase
constructing subinterpreter accelerator verifying symtable accidentally critical encodable untracked mutation
repeating surrogates resizing configurations scrollbar subparts sequential snapshot precedes straight browsers
unfortunately launcher architectures detached delegated disabling borrowed debugged stepping unconditional enabling
declarations centered compresslevel tempfile modifiers pythonware compiles diagnostic rendering distance repetitions
summarize installs seekable namedtuple determining tokenize collisions approximate faithfully accumulate uniquely
publicity truncates inheritable unusable contrarily families violation registration eliminate satisfied inclusion
punctuation searches adjustment submodules unbuffered flexibility integration strongly population exponents
demonstration agreement coefficient probability explained reproducible rational procedure continuations meanings
checksum timestamps constraint collapsed nonnegative multiplying nonempty manipulating reduction numerically retrieval
continues extracting excluded classmethods interfere published reentrant conflicting simultaneously powerful
inefficient dedicated accidental gathered extracts obviously suspended interactions escaping harmless yourself
exceptional examined unhandled excludes acquired progress transaction communicate syntactically transmit restarted
unfinished surrounded substrings initializer definitely everywhere overloaded hopefully argparse segmentation consumes
mutually profiling friendly developed redirects ellipsis accident insufficient behaviors warranty alternatives
assignments initializing hardware dimensional coordinate whichever interact comprehensive consumer indirect launched
deadlocks sophisticated familiar generics checkers inappropriate toplevel successively question faulthandler ancestor
retrieves perfectly visibility exclamation unlimited illustrates metaclasses continuing proposed enforced consistently
historical appearing decremented delegation specialization decreasing destruction facilities singletons semicolons
internet transmission itertools transitions carriage unquoted injected demonstrates buildbot generous synchronize
infrastructure equivalence appeared scenario multibyte pointers delegator keybinding foreground pressing turtledemo
iterates settable importable encrypted conforms extraction vulnerable breakage junctions manipulate conservative
localized decompressed simulates abruptly normalizing renaming considerably captures complication traditional
responsibility filepath inspecting installing immortal patching unwrapped finalizers daemonic analysis strategy
accurately substitute multiply ignorable suggested distinguishes translating reconstructing selectively refactor
alphabetical concatenate capabilities numbering presumably unencoded lookahead stacking regenerate replacements
documents interactively standards fallbacks contributed variance numerator interior multiples everyone interpolation
relations simplifies estimated proportional surprising promised eligible evaluating limiting scientific conforming
indication compensate inverted additionally substituted mathematical hardlink finishing unreadable recommends baseline
interfering introduction measured extremely compressor encapsulated irrelevant extensible switches supplying
reproducing complains traversing primitives exhaustive unacceptable tracemalloc overload encapsulates plaintext
awaiting requirements strptime abstraction validated revealed forwarded collapse overflowing dataclasses arranges
reentrancy profiler posixmodule releasing unlocked incrementing similarity resetting activity identification databases
simulated accordingly converter directives ambiguities deactivate involves abbreviations ascending administrative
subsequence intuitive conflicts intersection positives doctests refactoring dragging stretched mainloop redistribute
invisible clicking configurable expectations containment synchronously semantically prohibited frozensets pickleable
annotate manifest avoiding importers superset artificial unordered
""".split()
