import pytest

from graphloom.llm import residue as r

GOOD = "The region index keeps every parent block before the next version is written. It lists the entries of {}."
CASES = [
    *(GOOD.format(x) for x in ["{{ name }}", "{{name | title}}", "{% if x %}", "<%= x %>", "${user.name}", "#{x.y}", "%(name)s", "%NAME%", "$NAME$", "標記{0}讓", "は[LABEL NAME]です", "理%ENTRY%即", "為__REPORT_TREE__。", "は$NAME$です",  "@@NAME@@", "__NAME_HERE__", "[Insert name here]", "[BLOCK NAME]", "[TODO: add text]", "<your name here>", "<INSERT NAME>", "<<name>>", "{name}", "{0}", "[[fill in name]]", "[Beschreibung hier einfügen]", "<Name des Moduls eintragen>", "[вставьте описание]", "[inserir a descrição aqui]", "（此處填入名稱）", "【ここに説明を記入】"]),
    GOOD.format("it") + "\n\nLorem ipsum dolor sit amet consectetur.", "Sed veniam tempor labore dolore aliqua.", "xxxx xxxx xxx", "asdf asdf qwer asdf", "blah blah blah", "- Your text goes here.", "| a | b |\n|---|---|\n| {{ x }} | 1 |",
    "Hier steht später der Text.", "此處為範例文字，請自行替換。", "ここにテキストが入ります。",
    "404 Not Found\n\nThe requested path /a/b was not found on this server.", "Home | Search | Contact\n\n503 Service Unavailable\nRequest id: 1b2c3d4e\n\nWe are working on it and will be back soon.", "Please enable JavaScript to view this page.", '{"error": "timeout", "status": 504}',
    "<html><head><title>Error</title></head><body><h1>Bad Request</h1><p>9c80850e</p></body></html>", "Menu | Start\n\n<html><head><title>Error</title></head><body><h1>Bad Request</h1></body></html>\n\nGo back to the previous page. Check the address and try again.", "Traceback (most recent call last):\n  File \"a.py\", line 1, in b\nKeyError: 'x'", "java.lang.IllegalStateException: x\n\tat app.Main.run(Main.java:6)", "undefined", "[object Object]",
    "Zugriff verweigert. Bitte melden Sie sich an.", "系統忙碌中，請稍後再試。", "Для просмотра этой страницы включите JavaScript.", "PAGE NOT FOUND", "Error: ENOENT: no such file or directory, open '/a/b'",
]
KEPT = [
    None, "", " \n\t", GOOD.format("it"), *(GOOD.format(x) for x in ["`{{ name }}`", "“[Insert name here]”", "„{name}“", "「{{ x }}」", "the TODO comments", "`List<Scope>`", "a cost of $5 or US$9",  "[2025-03-14]", "(350 of 2569 nodes)", "[a link](http://x.y)", "__init__"]),
    "```\n<h1>{{ x.y }}</h1>\n```\n\n" + GOOD.format("it"), "The session expired notice is now part of the sign-in feature and no longer of the error pages.", "The handler answers with 404 Not Found when the project is unknown, and two tests cover this case.",
    "Feature 404 in the old numbering is now called the archive view.", 'The new text of the notice is "Please enable JavaScript to view this page" and replaces the older wording.', "Old descriptions with the words `lorem ipsum` are rejected by the label check.",
    "Die Meldung „Seite nicht gefunden“ wurde für das Archiv neu formuliert.", "The retry rule was extended: a 503 from the scanner is tried three times before the doubt is opened.", "| rule | locale |\n|---|---|\n| slot | 787 |", "A" * 100_000, '{"name": "x"}', "Overview",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert r.is_case(text)
    assert r.is_case(text.replace("\n", "\r\n"))


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert not r.is_case(text)


def test_long_documents_hide_nothing():
    assert r.is_case((GOOD.format("it") + "\n\n") * 3000 + "{{ x }}")
    assert not r.is_case((GOOD.format("it") + "\n\n") * 3000 + "404 Not Found")


def test_table(spark):
    texts = CASES + KEPT
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(0, texts[0], True)], "doc_id bigint, text string, has_residue boolean")
    found = [x.doc_id for x in r.cases(df).collect()]
    assert sorted(found) == [*range(len(CASES))]
    assert {x.doc_id for x in r.without_cases(df).collect()} == {*range(len(CASES), len(texts))}
    assert r.cases(df.limit(0)).count() == 0


def test_notices_without_a_phrase():
    assert all(map(r.is_notice, ("HTTP404", "at a.b(C.java:3)\nat a.c(C.java:9)", 'File "x", line 3')))


def test_no_length_hides_a_placeholder():
    for n in (10, 130, 500, 5_000):
        assert r.is_case(GOOD.format("{{ " + "a" * n + " }}")) and r.is_case(GOOD.format("[insert " + "name " * n + "]")) and r.is_case(GOOD.format("%" + "A" * n + "%"))
        assert not r.is_case(GOOD.format("it") + ' It says "' + "word " * n + '{{ x }}" there.')
    assert r.is_case(GOOD.format("[insert the name\nof the block]")) and not r.is_case(GOOD.format("it") + " [insert\n\nname]")


#: Written by hand in the wording of sites at large; the phrase lists were mended by what of these was missed at first.
SEEN = [
    "Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.", "We can't find that page.", "This content isn't available right now", "Please turn on JS in your browser",
    "This site is protected", "Oops! Something went wrong on our end. Please try again later.", "You need to enable JavaScript to run this app.", "Just a moment... Checking your browser before accessing the site.",
    "Error establishing a database connection", "This site can't be reached. The server took too long to respond.", "Sorry, you have been blocked", "Please verify you are a human", "Your session has timed out. Please log in again.",
    "The page you requested could not be found. It may have moved.", "HTTP Error 503. The service is unavailable.", "We're sorry, but our site is down for maintenance. We'll be back shortly.", "You do not have permission to access this resource.",
    "Algo ha fallado al cargar esta página", "Lo sentimos, la página que buscas no existe.", "Debes iniciar sesión para continuar.", "Por favor, habilita JavaScript en tu navegador.", "La pagina richiesta non esiste.", "Si è verificato un errore. Riprova più tardi.",
    "Diese Seite existiert leider nicht.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Hoppla, da ist etwas schiefgelaufen. Bitte versuchen Sie es später erneut.", "Sie haben keinen Zugriff auf diese Seite.", "Oups ! Cette page est introuvable.",
    "Veuillez activer JavaScript pour continuer.", "Vous devez être connecté pour voir cette page.", "Une erreur inattendue s'est produite. Veuillez réessayer.", "Desculpe, não encontramos a página que você procura.", "Ocorreu um erro inesperado. Tente novamente mais tarde.",
    "Para continuar, habilite o JavaScript no seu navegador.", "К сожалению, такой страницы нет.", "Что-то пошло не так. Попробуйте обновить страницу.", "Доступ к этой странице ограничен.", "抱歉，您访问的页面不存在。", "請開啟 JavaScript 以繼續使用本網站。", "系统出错了，请稍后再试。",
    "お探しのページは見つかりませんでした。", "このサイトを利用するにはJavaScriptを有効にしてください。", "エラーが発生しました。しばらくしてからもう一度お試しください。", "De pagina die u zoekt bestaat niet.", "Add your text here", "Enter text here", "This is a placeholder for the introduction.", "Text folgt.", "%%NAME%%", "Dear [First Name], welcome to [Company Name].",
    "Section under construction", "Content to be added.", "[Your Name Here]", "Hello {{user}}, your order {{order_id}} has shipped.",
    "We looked everywhere but this page is missing.", "The page you are looking for was moved or deleted.", "Sorry! That page has gone missing.", "Whoops, looks like something went wrong.", "This video is unavailable.", "You must be signed in to see this page.", "Access to this resource on the server is denied!",
    "JavaScript seems to be disabled in your browser. For the best experience, turn it on.", "Your browser does not support JavaScript.", "This web app needs JavaScript to work.", "Our servers are busy right now. Please try again in a moment.", "We are performing scheduled maintenance and will return soon.",
    "Request blocked. We can't connect to the server for this app or website at this time.", "The connection has timed out", "Bad gateway. Error code 502.", "Too many requests. Slow down and try again later.", "Die gesuchte Seite wurde leider nicht gefunden.", "Der Server ist zurzeit nicht erreichbar.",
    "Für diese Anwendung muss JavaScript aktiviert sein.", "Bitte melden Sie sich an, um fortzufahren.", "Désolé, le contenu demandé n'existe plus.", "Notre site est en cours de maintenance.", "JavaScript est désactivé dans votre navigateur.", "Accès refusé : vous n'avez pas les droits nécessaires.",
    "Vaya, no encontramos esa página.", "Tu sesión ha expirado. Vuelve a iniciar sesión.", "Este sitio necesita JavaScript para funcionar.", "Servidor no disponible, inténtalo más tarde.", "Ops! Algo deu errado.", "Você precisa fazer login para acessar esta página.", "Seu navegador não suporta JavaScript.",
    "Страница, которую вы ищете, не существует.", "Для работы сайта необходимо включить JavaScript.", "Сервис временно недоступен, повторите попытку позже.", "页面加载失败，请刷新重试。", "您没有权限查看此页面。", "您的瀏覽器未啟用 JavaScript。", "ページの読み込みに失敗しました。", "ログインが必要です。", "現在メンテナンス中です。",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Type your text here.", "Hier kommt noch Text hin.", "{{title}}", "Hi ${name}, thanks for joining.", "[Insert description]", "TODO: add description here", "<Your company name>",
]
#: Written by hand after that, and not looked at since: what is missed here stays missed.
HELD_OUT = [
    "Sorry, we can't seem to find what you're looking for.", "Error 404: the file you requested does not exist.", "You don't have permission to view this directory or page.", "Please log in to your account to continue.", "This page is only available to members.",
    "Please enable cookies and reload the page.", "To use this site, please enable JavaScript in your browser settings.", "Unable to load the page. Check your internet connection.", "An unexpected error has occurred. Our team has been notified.", "This service is temporarily unavailable due to maintenance.",
    "The request could not be completed. Try again in a few minutes.", "Complete the CAPTCHA to prove you are not a robot.", "Die Seite konnte nicht geladen werden.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.", "JavaScript ist in Ihrem Browser deaktiviert.", "Zugriff verweigert: Sie haben keine Berechtigung.",
    "La page que vous recherchez n'existe pas.", "Service momentanément indisponible.", "Activez JavaScript pour utiliser ce site.", "Votre session a expiré, veuillez vous reconnecter.", "No tienes permiso para acceder a esta página.", "Se ha producido un error inesperado.", "Activa JavaScript para continuar.", "Página no disponible.",
    "Página não disponível.", "Sua sessão expirou. Faça login novamente.", "Ative o JavaScript para usar este site.", "Страница временно недоступна.", "Пожалуйста, включите JavaScript в настройках браузера.", "Ошибка сервера. Попробуйте позже.", "服务器错误，请稍后再试。", "请启用 JavaScript 后继续访问。", "您访问的内容已被删除。", "アクセスが拒否されました。", "JavaScriptを有効にして再読み込みしてください。", "サーバーが混み合っています。",
    "Lorem ipsum dolor sit amet.", "Your description goes here.", "Insert your text here.", "{{ company_name }}", "[Enter title here]", "<insert date>", "Texte à compléter.", "Texto de ejemplo.", "Platzhaltertext", "ここにテキストを入力してください。",
]
#: How many of the 46 are missed, as measured once.
RECALL_MISSES = 11
#: Texts with real content that stand near a notice.
HELD_OUT_KEPT = [
    "The login page shows an error when the password is wrong, and the tests check the wording.", "We moved the maintenance notice to the footer and made the retry button larger.", "The parser reports a missing file as an error record instead of stopping the run.",
    "JavaScript sources are read by the same module as TypeScript, with one table of endings.", "Visitors without an account may read the archive but not the drafts.", "Die Fehlermeldung beim Anmelden wurde in der neuen Version verständlicher formuliert und getestet.",
    "Le module de connexion garde la session ouverte pendant trente minutes et la ferme ensuite.", "El servidor guarda una copia de cada versión antes de borrar las anteriores.", "The queue is drained before the service stops, so no job is lost.", "Сервер хранит копию каждой версии и удаляет старые раз в неделю.",
    "此版本修正了登入流程的兩個問題，並補上測試。", "サーバーは毎晩すべての版の控えを作り、古いものを消します。", "The access log lists who read which page and when.", "Blocks that no feature needs are removed at the end of the run.", "Reviewers found that the summary repeats the first section.",
    "Cookies are used only for the language of the viewer.", "The page index is rebuilt once a day.", "A request that takes longer than thirty seconds is cancelled and counted.", "The status column holds one of four values.", "Permission checks run before the report is written.",
]


def test_recall_on_held_out_notices():
    assert sum(not r.is_case(t) for t in SEEN) <= 1
    missed = [t for t in HELD_OUT if not r.is_case(t)]
    assert len(missed) <= RECALL_MISSES, missed
    assert [t for t in HELD_OUT_KEPT if r.is_case(t)] == []
