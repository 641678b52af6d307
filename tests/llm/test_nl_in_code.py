import pytest

from graphloom.llm import nl_in_code as n

SENTENCES = {
    "en": "The region index keeps every parent block before the next version is written.", "de": "Der Planer liest die betroffenen Funktionen bevor die nächste Fassung entsteht.",
    "fr": "Le module compte les écarts trouvés et laisse le reste intact.", "es": "El registro descarta los nodos afectados y deja el resto sin tocar.",
    "pt": "O planejador ordena as diferenças encontradas quando a leitura termina.", "ru": "Каждый снимок сортирует родительский блок даже если вызов неизвестен.",
    "zh": "關聯表會統計名稱重複的項目，讓審查的人看到同一個結果。", "ja": "このモジュールは以前の説明を順位の高いものから確認します。",
}


@pytest.mark.parametrize("language", n.LANGUAGES)
def test_sentences(language):
    assert n.sentence_language(SENTENCES[language]) == language
    assert n.span_languages(f"TODO: {SENTENCES[language]}") == {language: len(SENTENCES[language].encode())}


@pytest.mark.parametrize(
    "text",
    ["", "one two three four", "SELECT a_id, b FROM c WHERE b > 0 and d", "const drift = link;", "src/block/index.json and a/b/c d/e", "--------------------", "return the value of it;", "foo_bar baz_qux a.b.c d::e f->g", "// edge # rank", "x" * 5000, "這是七個字呢嗎"],
)
def test_no_sentences(text):
    assert n.span_languages(text) == {}


def test_spans_resolve_escapes():
    py = '"\\u0041 b"  # c one\n# c two\nx = r"\\u0041" + b"\\x41" + \'\'\'d\ne\'\'\'\nf"g"'
    assert list((t for t, _ in n.spans("python", py))) == ["A b", "\\u0041", "A", "d\ne", "g", "c one\nc two"] or sorted((t for t, _ in n.spans("python", py))) == sorted(["A b", "c one\nc two", "\\u0041", "A", "d\ne", "g"])
    assert list(n.spans("java", 'String s = "\\u00e4\\n\\ud83d\\ude00"; /* a\n * b */ char c = \'"\';'))[0][0] == "ä\n😀"
    assert list(n.spans("csharp", 'var a = @"x\\y ""q"" z";'))[0][0] == 'x\\y ""q"" z'
    assert list(n.spans("go", "a := `x\\ny` // z"))[0][0] == "x\\ny"


def test_wrapped_sentences_are_joined():
    text = "The region index keeps every\nparent block before the next\nversion is written. It is done now as well."
    assert n.span_languages(text)["en"] == len(text) - 1


def test_table(spark):
    source = "\n".join([f"# {SENTENCES['en']}", f'x = "{SENTENCES["de"]}"', "def f():", f'    """{SENTENCES["ja"]}"""', "y = 1"])
    ddl = "file_id bigint, path string, language string, content string, share string"
    rows = [(i, "a.py", None, source, "x") for i in range(40)] + [(0, "a.py", None, source, "x"), (90, "b.go", None, "// nothing", "x"), (91, "b.go", None, None, "x"), (92, "b.zip", None, source, "x"), (93, "c.ts", None, f"/* {SENTENCES['fr']} */", "x")]
    files = spark.createDataFrame(rows, ddl)
    for hot_rows in (10**6, 5):
        got = {(r.file_id, r.nl_lang): r for r in n.file_languages(files, hot_rows).collect()}
        assert {*got} == {(i, g) for i in range(40) for g in ("en", "de", "ja")} | {(93, "fr")}
        assert got[0, "en"].n_bytes == len(SENTENCES["en"]) + 2 and got[0, "en"].share == pytest.approx((len(SENTENCES["en"]) + 2) / len(source.encode()))
        assert all(sum(r.share for k, r in got.items() if k[0] == i) <= 1 for i in range(40))
    assert n.file_languages(files.limit(0)).count() == 0


#: Written by hand, apart from the word lists.
HELD_OUT = {
    "en": ["Returns cached totals computed earlier yesterday.", "We retry at most three times and give up after that.", "Never call this from the main thread.", "Callers own the returned buffer.", "Sorted by name, oldest first.", "Keeps track of open files across restarts."],
    "de": ["Gibt die Anzahl der offenen Aufträge zurück.", "Wird nur beim ersten Start aufgerufen.", "Achtung: diese Methode blockiert den Aufrufer.", "Prüft, ob die Datei bereits existiert.", "Der Wert darf nicht leer sein."],
    "fr": ["Renvoie la liste des fichiers ouverts.", "Cette méthode est appelée au démarrage.", "Vérifie si le fichier existe déjà.", "La valeur ne doit pas être vide.", "Ferme la connexion après chaque requête."],
    "es": ["Devuelve la lista de archivos abiertos.", "Este método se llama al iniciar.", "Comprueba si el archivo ya existe.", "El valor no puede estar vacío.", "Cierra la conexión después de cada consulta."],
    "pt": ["Devolve a lista de arquivos abertos.", "Este método é chamado na inicialização.", "Verifica se o arquivo já existe.", "O valor não pode ser vazio.", "Fecha a conexão depois de cada consulta."],
    "ru": ["Возвращает список всех открытых файлов.", "Этот метод вызывается один раз при запуске.", "Проверяет, существует ли уже такой файл.", "Значение не должно быть пустым никогда.", "Закрывает соединение после каждого запроса."],
    "zh": ["返回所有打开的文件列表。", "此方法仅在启动时调用一次。", "检查文件是否已经存在。", "該值不可以是空的字串。"],
    "ja": ["開いているファイルの一覧を返します。", "このメソッドは起動時に一度だけ呼ばれます。", "ファイルが既に存在するか確認する。", "値は空であってはなりません。"],
}
OTHERS = [
    "Restituisce il numero di righe che sono state lette.", "Questa funzione viene chiamata solo una volta.", "Controlla se il file esiste già.", "Geeft het aantal regels terug dat is gelezen.", "Deze functie wordt maar één keer aangeroepen.", "Controleert of het bestand al bestaat.",
    "Повертає список усіх відкритих файлів.", "Перевіряє, чи існує вже такий файл.", "Zwraca liczbę wierszy, które zostały odczytane.", "Sprawdza, czy plik już istnieje.", "Returnerar antalet rader som har lästs.", "Kontrollerar om filen redan finns.",
]


def test_recall_on_held_out_sentences():
    """Recall by language and how often another language is taken for one of the eight, as measured once."""
    right = {k: sum(n.sentence_language(x) == k for x in v) for k, v in HELD_OUT.items()}
    wrong = [(k, x) for k, v in HELD_OUT.items() for x in v if n.sentence_language(x) not in (k, None)]
    assert len(wrong) <= 1, wrong
    assert sum(right.values()) >= 36, right
    assert sum(n.sentence_language(x) is not None for x in OTHERS) <= 2, [x for x in OTHERS if n.sentence_language(x)]
