import pytest

from graphloom.llm import docpairs as p
from graphloom.llm.lexical import balanced, language_of

PY = '''
# def not_this(): "This comment is not a function at all."
TEXT = """
def nor_this():
    "This string is not a function at all."
"""
class A:
    @wraps("x")  # note
    async def first(self, a: dict[str, int] = {"a": 1}, *b) -> dict[str, list[int]]:
        # a comment may come before
        r"""Reads the longest chain
        and writes one line per finding.

        Args:
            a: the a
        """
        def inner():
            """This one is inside and does not count here."""
        return ")"

    def second(self): "Das Modul liest jede ge\\u00e4nderte Datei sofort."; return None

def third(x=")", y="#"):
    ("Joined texts are one "
     "docstring of several words.")

def fourth(): pass
def fifth():
    """TODO: write this text once it is stable"""
def sixth():
    """
    Args:
        region:
        other:
    """
def seventh():
    f"""This is no docstring because it is formatted."""
def eighth(): """函式會讀取節點清單並回報。"""
\tdef broken(
'''
TS = '''
// function no(x) { return x }
const SAMPLE = `
/** This is inside of a template and no function at all. */
function hidden() { return `${ {a: "}"} }`; }
`;
export class A {
  /** The first comment is not the one that counts. */
  /**
   * Reads every parent block before the graph was loaded.
   * @param a
   */
  @Memo({ x: ")" })
  private static async load<T extends { a: string }>(a: Map<string, number> = f("}"), b?: { c: string }): Promise<Map<string, {x: T}>> {
    /** This inner function has words but does not count. */
    function inner() {}
    if (a) { return /[}"]/; }
    return "}";
  }
  /** Check load thing */
  check(): void {}
}
/** Groups the entries without an owner and leaves the rest. */
export const plan = async ({ a, b }: Opts): Promise<number> => {
  return 1;
};
/** Counts all of the things that are there now. */
const short = x => x * 2;
if (a) { b() }
/** The value is not a function but has many words. */
const value = load("x", function () { return 1 });
'''
JAVA = '''
package a;
/** The class comment has more than five words as well. */
public class A<T> {
    /**
     * Reads the longest chain and the batch numbers.
     * @param x
     */
    @Timed("}") @Deprecated
    protected static <K> Map<String, List<K>> read(final Map<String, Integer> x, char c) throws IOException, X {
        char q = '"'; String s = "{";
        Runnable r = new Runnable() { public void run() {} };
        return null;
    }
    /** Interne Hilfe. */
    void help() {}
    /** Tells all of the callers that something has changed. */
    void tell(int a);
    private int field = compute(1);
    /** Makes a new one from the given parts here. */
    A(int x) { this.x = x; }
}
'''
GO = '''package a

// Reads the longest chain and the batch numbers.
func (s *A[T]) Read(a map[string]int, f func(int) error) (map[string]interface{}, error) {
	x := `}`; y := '{'
	g := func() int { return 1 }
	return nil, nil
}

// This comment is not directly above the function.

func Far() int { return 1 }

/* A block comment directly above counts as well. */
func Near() interface{} { return 1 }

// TODO describe
func Todo() {}
'''
RUST = '''
//! The module comment is no comment of a function.
pub struct A<'a> { x: &'a str }
impl<'a> A<'a> {
    /// Reads the longest chain and the batch numbers.
    ///
    /// # Arguments
    /// * `x`
    #[cfg(feature = "}")]
    pub(crate) async fn read<F: Fn(i32) -> i32>(&'a self, x: [u8; 4], f: F) -> Result<Vec<&'a str>, String> where F: Send {
        let c = '}'; let r = r#"}"#; /* nested /* } */ */
        fn inner() {}
        log!("{");
    }
    /** A block comment in Rust counts as well here. */
    fn block() {}
    //// four slashes are no documentation comment at all
    fn plain() {}
}
'''
CS = '''
namespace A;
public class B {
  /// <summary>
  /// Reads the longest chain and the batch numbers.
  /// </summary>
  /// <param name="x"></param>
  [Route("a}")]
  public static List<string> Read(Dictionary<string, int> x, string y = @"a""}")
  {
    var s = $"{x}"; var c = '}';
    return null;
  }
  /// <summary>Interne</summary>
  int Small() => 1;
  /// <summary>Gives the number of all the entries back.</summary>
  public int Count(int a) => a + 1;
}
'''


def found(language, text):
    return [(name, line) for name, line, doc, *_ in p.functions(language, text) if doc is not None]


def line_of(text, part):
    return text[: text.index(part)].count("\n") + 1


def test_python():
    assert found("python", PY) == [(n, line_of(PY, f"def {n}(")) for n in ("first", "second", "third", "eighth")]
    by = {f[0]: f for f in p.functions("python", PY)}
    assert by["first"][3] == ["self", 'a: dict[str, int] = {"a": 1}', "*b"] and by["first"][4] == "method" and "geänderte" in by["second"][2]
    assert "inner" not in by and by["first"][5].rstrip().endswith('return ")"')


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("typescript", TS, ["load<T", "plan =", "short ="]), ("java", JAVA, ["read(final", "tell(int", "A(int"]), ("go", GO, ["Read(a", "Near("]),
        ("rust", RUST, ["read<F", "block("]), ("csharp", CS, ["Read(Dict", "Count(int"]),
    ],
)
def test_languages(language, text, names):
    want = [(__import__("re").match(r"\w+", n).group(), line_of(text, n)) for n in names]
    assert found(language, text) == want


def test_crlf_and_odd_texts():
    assert found("java", JAVA.replace("\n", "\r\n")) == found("java", JAVA)
    for language in ("python", "typescript", "java", "go", "rust", "csharp"):
        for text in ("", "\n", '"', "'", "/*", "/**", "{", "}" * 50, "def f(", "func (", "(" * 2000, '"""', "`${", "\\"):
            assert found(language, text) == []


@pytest.mark.parametrize(
    ("text", "name", "trivial"),
    [
        ("", "f", True), ("one two three four", "f", True), ("one two three four five", "f", False), ("Load the trigger module of plan.", "load_trigger_module_plan", True),
        ("函式讀取節點清單", "f", False), ("函式讀取節點清", "f", True), ("TODO: explain what this function does", "f", True), ("This is to be documented later on.", "f", True),
        ("@param a\n@param b\n@returns {number}", "f", True), (":param a:\n:param b:\n:return:", "f", True), ("Parameters\n----------\na\nb\nc\nd\ne", "f", True),
        ("<summary> </summary>\n<param name=\"a\"></param>", "f", True), ("# Arguments\n* `a`\n* `b`\n* `c`\n* `d`\n* `e`", "f", True),
        ("@param a the number of entries that are kept", "f", False), ("x" * 10_000, "f", True),
    ],
)
def test_trivial(text, name, trivial):
    assert p.is_trivial(text, name) is trivial


def test_table(spark):
    ddl = "file_id bigint, path string, language string, content string, name string"
    rows = [(1, "a.py", None, PY, "x"), (1, "a.py", None, PY, "x"), (2, "a.txt", None, PY, "x"), (3, "a.java", "", JAVA, "x"), (4, "a.go", "go", None, "x"), (5, "a.go", "go", "", "x"), (None, None, None, "x", None)]
    got = p.documented_names(spark.createDataFrame(rows, ddl)).collect()
    assert len(got) == 4 + 3 and {r.file_id for r in got} == {1, 3}
    assert p.documented_names(spark.createDataFrame([], ddl)).count() == 0
    assert language_of("C#", "x.py") == "csharp" and language_of(None, "x.TSX") == "typescript" and language_of("cobol", "x.cob") is None


def test_stray_bracket_whose_partner_is_in_a_comment():
    text = "/** Adds the numbers of both sides. */\nfunction add(a, b) {\n  // done )\n  return ( a + b;\n}\n"
    assert "( a" not in balanced("javascript", text) and "// done )" in balanced("javascript", text)
