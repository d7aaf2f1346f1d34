"""Small sources of the languages whose tests are told apart; each hit line holds a marker prod_N or test_N, so they say what a filter must keep."""

EXAMPLES = {
    "Rust": "fn a() { mk_prod_1(); }\n#[derive(Debug)]\nstruct S { mk_prod_2: u8 }\n#[test]\nfn t() { if x { mk_test_1(); } mk_test_2(); }\n#[cfg(all(test, unix))]\nmod m { fn q() { mk_test_3(); } }\nfn b() { mk_prod_3(); }\n",
    "Go": "func a() { mk_prod_1() }\nfunc TestA(t *T) { mk_test_1() }\nfunc (s *S) TestB() { mk_test_2() }\nfunc Testing2 int\nvar testX = mk_prod_2\n",
    "Java": "class A { int mk_prod_1;\n@Override void f() { mk_prod_2(); }\n@Test(timeout = 1)\n void t() { mk_test_1(); }\n@org.junit.BeforeEach void s() { mk_test_2(); }\n int mk_prod_3; }\n",
    "C": "int test_x = mk_prod_1;\nvoid test_a(void);\nvoid b(void) { mk_prod_2(); }\nvoid test_a(void) { mk_test_1(); }\nTEST(A, B) { mk_test_2(); }\nvoid c(void) { mk_prod_3(); }\n",
    "Python": "def a():\n    mk_prod_1()\n\ndef test_a():\n    mk_test_1()\n    mk_test_2()\n\nclass TestB:\n    def f(self):\n        mk_test_3()\n\n@pytest.fixture\ndef g():\n    mk_test_4()\n\n@other\ndef h():\n    mk_prod_2()\n",
    "Zig": 'fn a() void { mk_prod_1(); }\ntest "x" { mk_test_1(); }\nfn b() void { mk_prod_2(); }\n',
    "Javascript": 'const a = mk_prod_1;\ndescribe("x", () => { it("y", () => { mk_test_1(); }); mk_test_2(); });\nmk_prod_2();\n',
    "Csharp": "class A { int mk_prod_1;\n[Obsolete] void f() { mk_prod_2(); }\n[Fact]\n[Trait] void t() { mk_test_1(); } }\n",
    "Ruby": "def a\n  mk_prod_1\nend\ndescribe 1 do\n  it 2 do\n    mk_test_1\n  end\n  mk_test_2\nend\ndef b\n  mk_prod_2\nend\n",
    "Scala": 'val a = mk_prod_1\ntest("x") { mk_test_1 }\nval b = mk_prod_2\n',
    "R": 'f <- mk_prod_1\ntest_that("x", { mk_test_1 })\ntest _ that ("y", { mk_test_2 })\ng <- mk_prod_2\n',
    "Clojure": "(defn a [] mk_prod_1)\n(deftest b (is mk_test_1))\n(defn c [] mk_prod_2)\n",
    "D": "int mk_prod_1;\nunittest { mk_test_1(); }\nint mk_prod_2;\n",
    "Erlang": "a() -> mk_prod_1.\nb_test() -> mk_test_1,\n  mk_test_2.\nc() -> mk_prod_2.\n",
    "Dart": 'var a = mk_prod_1;\ngroup("x", () { mk_test_1(); });\nvar b = mk_prod_2;\n',
    "Kotlin": "fun a() { mk_prod_1() }\n@Test fun t() { mk_test_1() }\ninterface I {\n  @Test\n  fun s()\n}\nfun b() { mk_prod_2() }\n",
    "Swift": "func a() { mk_prod_1() }\nfunc testA() { mk_test_1() }\n@Test func b() { mk_test_2() }\nfunc c() { mk_prod_2() }\n",
    "Perl": 'mk_prod_1();\nsubtest "x" => sub { mk_test_1(); };\nmk_prod_2();\n',
    "Elixir": 'def a do\n  mk_prod_1\nend\ntest "x" do\n  mk_test_1\nend\ndef b do\n  mk_prod_2\nend\n',
    "Cpp": "int test_y = mk_prod_1;\nTEST_F(Fix, name) { mk_test_1(); }\nvoid Testing();\nSECTION(\"x\") { if (a) { mk_test_2(); } }\nclass TestLike { int mk_prod_2; };\nvoid f() { Testing(); mk_prod_3(); }\n",
    "Fsharp": 'let a x =\n    mk_prod_1 x\n\n[<Test>]\nlet b () =\n    let c = mk_test_1\n    c\n\n[<Fact(Skip = "no")>]\n[<My.Trait("x")>]\nlet d () =\n    mk_test_2\n\ntype E = { F: int }\nlet g = mk_prod_2\n\n[<Obsolete>]\nlet h = mk_prod_3\n\nlet all =\n    testList "x" [\n        testCase "y" <| fun () -> mk_test_3\n        test "z" { mk_test_4 }\n    ]\nlet i = mk_prod_4\n',
    "Haskell": 'a :: Int\na = mk_prod_1\n\nb :: Spec\nb = describe "x" $ do\n  it "y" $ mk_test_1\n  context "z" $ mk_test_2\n\nprop_c :: Int -> Bool\nprop_c n = mk_test_3 n\n\nd :: Int\nd = mk_prod_2\n',
    "Julia": '@testset "x" begin\n  if a\n    mk_test_1\n  end\n  @test mk_test_2\nend\n@test mk_test_3 == 1\nfunction f(x)\n  mk_prod_1\nend\n@test_throws Error(mk_test_4)\nfunction g(x)\n  mk_prod_2\nend\n',
    "Nim": 'proc a() =\n  mk_prod_1\nsuite "x":\n  test "y":\n    mk_test_1\n  test "z":\n    mk_test_2\nproc b() =\n  mk_prod_2\n',
    "ObjectiveC": "@implementation A\n- (int)make:(int)x {\n  mk_prod_1;\n}\n- (void)setUp {\n  mk_test_1;\n}\n- (void)testIt {\n  if (a) { mk_test_2; }\n}\n+ (void)tearDown { mk_test_3; }\n- (void)tested_not:(int)y;\n@end\nint b = mk_prod_2;\n",
    "OCaml": 'let a = mk_prod_1\nmodule Test_b = struct\n  let c = mk_test_1\nend\nlet d = mk_prod_2\n',
    "PHP": "<?php\nfunction a() { mk_prod_1(); }\nclass B extends C {\n  function testD() { mk_test_1(); }\n  function setUp() { mk_test_2(); }\n  function e() { mk_prod_2(); }\n}\nclass FTest { function g() { mk_test_3(); } }\nit('x', function () { mk_test_4(); });\nfunction h() { mk_prod_3(); }\n",
    "Bash": "mk_prod_1\n",
}
