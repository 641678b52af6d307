"""Template residue, filler text, and error, access or script notices in place of content.

A multi-pattern automaton finds the phrases of all languages in one pass over a document, and with them what placeholders
open with and what the lines of traces and error pages hold. What a hit means depends on how much of its sentence it
covers, and for error pages on how much of the document such sentences cover: a document that writes about an error page
has other sentences, an error page has none. At an opener a pattern checks whether a placeholder follows, and a line with
a sign is checked for a trace or a status. Code
blocks, code marks and quotations are taken out before placeholders and filler are looked for; text that is quoted isn't
the document's own.

A document is a case if its prose, headings, lists or tables hold a placeholder or filler, or if as a whole it is a notice.

Defined cases: null, empty and blank texts are no cases; very long texts are searched whole; a quotation mark or code
fence that isn't closed quotes to the end of its line or text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.operators.skew import spread

_rx = cache(regex.compile)
#: At least so much of a sentence must be phrases for it to be a notice or filler.
SENTENCE_COVERAGE = 0.4
#: At least so much of a document's sentences must be notices for it to be one.
DOCUMENT_COVERAGE = 0.7
NOTICE, FILLER, OPENER, SIGN, WEAK = range(5)

#: Phrases of error messages, error pages, and access or script notices, in lower case.
NOTICES = """
404 not found|not found|page not found|page is missing|gone missing|page has gone|this page isn't|this page is not|link may be broken|may be broken|be broken|may have been removed|page may have|page you were looking for|page you are trying to|doesn't seem to exist|does not seem to exist|page cannot be displayed|can't be displayed|cannot be displayed|url was not found|this page doesn't exist|this page does not exist|that page doesn't exist|we couldn't find|we could not find|we can't find|we cannot find|couldn't be found|can't be found|cannot be found|page isn't available|page is not available|isn't available right now|not available right now|content isn't available|content is not available|content is unavailable|no longer exists|has been deleted|has been removed|has moved|broken link|dead link|link you followed|nothing to see here|nothing was found|file not found|the requested path|the requested page|the requested url|the requested resource|was not found on this server|could not be found|can't find the page|cannot find the page|the page you are looking for|page you requested|does not exist or has been removed|may have been moved or removed|no longer available
403 forbidden|forbidden|access denied|must be signed in|must be logged in to|is denied|request blocked|has been blocked|you are human|you are a human|you're human|are human|are you human|you're a robot|you are a robot|not authorised|unauthorised|private page|this page is private|for members|must log in|have to log in|need to log in|need to sign in|must sign in|log in to view|log in to see|sign in to view|access is denied|access restricted|restricted area|not allowed to view|not allowed to access|you are not allowed|you don't have access|you do not have access|insufficient permissions|authentication required|authorization required|login required|sign-in required|log in or sign up|create an account to continue|this site is protected|protected by|you have been blocked|you've been blocked|your ip address|ip has been blocked|security check|security service|security verification|subscribe to continue|subscription required|access to this page has been denied|permission denied|you don't have permission|you do not have permission|not authorized|unauthorized|401 unauthorized|please sign in|please log in|sign in to continue|log in to continue|log in again|you must be logged in|members only|subscribers only|session has expired|session expired|your session
500 internal server error|internal server error|has timed out|timed out|can't connect|cannot connect to the server|servers are busy|is busy right now|return soon|performing scheduled maintenance|performing maintenance|service is unavailable|is unavailable|http error|went wrong|gone wrong|unexpected happened|having problems|is overloaded|server is busy|too busy|high traffic|is offline|internal error|error occurred|an error has occurred|there was an error|there was a problem|we ran into a problem|ran into an issue|we're having trouble|having technical difficulties|technical difficulties|website is currently|site is currently|currently unavailable|site can't be reached|this site can't be reached|took too long to respond|unable to connect|unable to load|failed to load|couldn't load|could not connect|cannot connect|lost connection|no internet connection|database connection|error establishing|service is down|out of service|be back shortly|we'll be back|we will be back|check back later|check back soon|come back later|try refreshing|try reloading|refresh and try|502 bad gateway|bad gateway|503 service unavailable|service unavailable|service temporarily unavailable|temporarily unavailable|504 gateway timeout|gateway timeout|gateway time-out|the upstream did not answer|did not answer in time|bad request|400 bad request|request timed out|connection timed out|timed out|connection refused|connection reset|too many requests|429 too many requests|rate limit exceeded|try again later|please try again|try again in a few minutes|and try again|something went wrong|an error occurred|an unexpected error|unexpected error|application error|fatal error|oops|the page could not be loaded|could not be loaded|reload the page|refresh the page|return to the start|go back to the home page|the server reported a problem|server error|while handling your request|under maintenance|down for maintenance|scheduled maintenance|we are working on it|will be back soon|no further details are available|check the address|contact the administrator|if the problem remains|if the problem persists|wait a minute|go back to the previous page|use the search field|the search field above|you typed the address|make sure that it is spelled correctly|spelled correctly|make sure the address|go to the home page|request id|reference number|error code|incident id|ray id
enable javascript|javascript is disabled|javascript seems to be disabled|javascript appears to be disabled|does not support javascript|doesn't support javascript|disabled in your browser|blocked in your browser|needs javascript|javascript is turned off|javascript is not enabled|javascript disabled|turn on js|enable js|js is disabled|requires js|works best with javascript|without javascript|javascript to continue|javascript to use|needs javascript|needs cookies|requires cookies|accept cookies|turn on cookies|cookies must be enabled|cookies are required|cookies are blocked|allow javascript|disable your ad blocker|ad blocker|please update your browser|outdated browser|upgrade your browser|supported browser|just a moment|please wait while|checking if the site connection is secure|verify that you are human|confirm you are human|confirm that you are not a robot|i'm not a robot|not a robot|prove you are human|javascript is required|javascript must be enabled|javascript to view this page|javascript to run this app|you need to enable|requires javascript|turn on javascript|turn javascript on|this application requires scripts|requires scripts|allow scripts|enable scripts|uses scripts and cookies|enable cookies|cookies are disabled|switch them on|in the settings of your browser|load the page once more|in your browser|some parts cannot be shown|browser is not supported|unsupported browser|update your browser|checking your browser|before you continue|this may take a few seconds|verify you are human|verifying you are human|are you a robot|complete the captcha|solve the captcha|unusual traffic
enoent|no such file or directory|eacces|econnrefused|etimedout|traceback (most recent call last)|stack trace|null pointer exception|nullpointerexception|segmentation fault|core dumped|out of memory|uncaught exception|unhandled exception|undefined is not a function|[object object]|undefined|nan
seite nicht gefunden|wurde leider nicht gefunden|nicht gefunden|javascript muss|muss javascript|javascript aktiviert|aktiviert sein|unterstützt kein javascript|kein javascript|existiert leider nicht|diese seite existiert|schiefgelaufen|schief gelaufen|schiefgegangen|später noch einmal|noch einmal versuchen|zugriff auf diese seite|auf diese seite|sie haben keinen|sie müssen sich|müssen angemeldet sein|müssen sich anmelden|leider nicht verfügbar|nicht angezeigt werden|nicht gefunden werden|wurde gesperrt|überlastet|seite existiert nicht|seite konnte nicht|konnte nicht gefunden werden|konnte nicht geladen werden|gibt es nicht|nicht mehr verfügbar|nicht vorhanden|seite ist nicht|zugang verweigert|kein zugriff|keinen zugriff|zugriff nicht gestattet|anmeldung erforderlich|bitte anmelden|bitte einloggen|fehler aufgetreten|interner fehler|technisches problem|technische probleme|hoppla|ups|versuchen sie es|bitte versuchen|zeitüberschreitung|javascript aktivieren|aktiviere javascript|javascript wird benötigt|benötigt javascript|javascript ist nicht aktiviert|cookies aktivieren|akzeptieren sie cookies|ihren browser|ihr browser|ihrem browser|nicht gefunden|die angeforderte seite|wurde nicht gefunden|existiert nicht|zugriff verweigert|keine berechtigung|bitte melden sie sich an|melden sie sich an|sitzung ist abgelaufen|sitzung abgelaufen|bitte aktivieren sie javascript|aktivieren sie javascript|javascript ist deaktiviert|um diese seite anzuzeigen|um fortzufahren|interner serverfehler|serverfehler|ein fehler ist aufgetreten|es ist ein fehler aufgetreten|etwas ist schiefgelaufen|versuchen sie es später|später erneut|erneut versuchen|dienst nicht verfügbar|derzeit nicht verfügbar|nicht erreichbar|wartungsarbeiten|zu viele anfragen|laden sie die seite neu
page introuvable|n'existe plus|contenu demandé|en cours de maintenance|accès refusé|n'avez pas les droits|pas les droits|ne prend pas en charge javascript|vous devez être connecté|être connecté|devez vous connecter|pour voir cette page|pour accéder à|erreur inattendue|s'est produite|cette page n'|page que vous cherchez|page que vous recherchez|vous recherchez|n'est plus|surchargé|momentanément|est indisponible|réessayer|page n'existe|n'existe plus|page est introuvable|nous ne trouvons pas|plus disponible|n'est pas disponible|page non trouvée|accès restreint|accès non autorisé|vous n'avez pas accès|vous n'êtes pas autorisé|connexion requise|identifiez-vous|oups|un problème est survenu|erreur du serveur|erreur serveur|problème technique|délai d'attente|impossible de charger|impossible d'afficher|impossible de se connecter|actualisez la page|rechargez la page|réessayez|javascript pour|javascript est requis|javascript doit être activé|nécessite javascript|accepter les cookies|activer les cookies|activez les cookies|votre navigateur|introuvable|la page demandée|n'existe pas|n'a pas été trouvée|accès refusé|accès interdit|vous n'avez pas l'autorisation|veuillez vous connecter|connectez-vous|session a expiré|veuillez activer javascript|activer javascript|activez javascript|javascript est désactivé|pour afficher cette page|pour continuer|erreur interne|le serveur a rencontré un problème|le serveur a rencontré|une erreur est survenue|une erreur s'est produite|veuillez réessayer|réessayez plus tard|service indisponible|temporairement indisponible|en maintenance|trop de requêtes
página no encontrada|no admite javascript|no es compatible con javascript|la página que buscas|la página que busca|que buscas|que está buscando|que estás buscando|lo sentimos|para ver este contenido|error inesperado|está caído|está saturado|no se puede mostrar|no se pudo conectar|no hemos encontrado|no encontramos|no se pudo encontrar|no se ha encontrado|no existe la página|ya no está disponible|ya no existe|no está disponible|acceso restringido|no está autorizado|no tienes permiso|no tienes acceso|no tiene acceso|inicia sesión|debe iniciar sesión|ha ocurrido un problema|ocurrió un error|hubo un error|hubo un problema|algo ha fallado|algo ha salido mal|algo fue mal|al cargar esta página|al cargar la página|no se pudo cargar|no se puede cargar|problema técnico|problemas técnicos|tiempo de espera|inténtalo de nuevo|inténtalo más tarde|vuelve a intentarlo|recargue la página|actualice la página|activa javascript|habilita javascript|javascript está deshabilitado|necesita javascript|requiere javascript|active las cookies|habilite las cookies|acepte las cookies|su navegador|tu navegador|no se encontró la página|no se encontró|la página solicitada|no existe|acceso denegado|acceso prohibido|no tiene permiso|inicie sesión|iniciar sesión|la sesión ha caducado|sesión ha expirado|active javascript|habilite javascript|activar javascript|javascript está desactivado|para ver esta página|para continuar|error interno|error del servidor|ha ocurrido un error|se ha producido un error|algo salió mal|inténtelo de nuevo|inténtelo más tarde|vuelva a intentarlo|servicio no disponible|no disponible temporalmente|en mantenimiento|demasiadas solicitudes
página não encontrada|precisa fazer login|fazer login|faça o login|não suporta javascript|a página que você procura|que você procura|página que você|que procura|desculpe|erro inesperado|para ver este conteúdo|não pode ser exibida|sobrecarregado|está fora do ar|fora do ar|não encontramos|não foi possível encontrar|não foi possível carregar|não está disponível|não está mais disponível|não existe mais|indisponível no momento|acesso restrito|acesso não autorizado|sem permissão|não tem acesso|você precisa estar logado|é necessário fazer login|entre na sua conta|aconteceu um erro|houve um erro|houve um problema|algo correu mal|problema técnico|problemas técnicos|tempo esgotado|tente de novo|recarregue a página|atualize a página|ative javascript|habilitar javascript|javascript desativado|javascript desabilitado|requer javascript|precisa de javascript|ative os cookies|habilite os cookies|aceite os cookies|seu navegador|não foi encontrada|não encontrada|a página solicitada|não existe|acesso negado|acesso proibido|você não tem permissão|não tem permissão|faça login|inicie sessão|sessão expirou|sua sessão|ative o javascript|habilite o javascript|ativar o javascript|javascript está desativado|para ver esta página|erro interno|erro no servidor|ocorreu um erro|algo deu errado|tente novamente|mais tarde|serviço indisponível|temporariamente indisponível|em manutenção|muitas solicitações
страница не найдена|не существует|которую вы ищете|не поддерживает javascript|к этой странице|доступ к этой странице|ограничен|к сожалению|непредвиденная ошибка|неизвестная ошибка|страница удалена|страница недоступна|недоступна|недоступен|сайт временно|сервер перегружен|чтобы продолжить|чтобы просмотреть|страницы не существует|такой страницы нет|не удалось найти|не найден|не найдено|больше не существует|удалена|доступ ограничен|доступ закрыт|у вас нет доступа|нет прав|требуется авторизация|авторизуйтесь|войдите, чтобы|необходимо войти|внутренняя ошибка сервера|возникла ошибка|не удалось загрузить|не удалось подключиться|технические неполадки|время ожидания|обновите страницу|перезагрузите страницу|попробуйте снова|попробуйте обновить|необходим javascript|требуется javascript|включить javascript|включите cookie|включите файлы cookie|ваш браузер|вашем браузере|не найдена|запрошенная страница|не существует|доступ запрещён|доступ запрещен|нет доступа|недостаточно прав|войдите в систему|пожалуйста, войдите|сеанс истёк|сессия истекла|включите javascript|javascript отключён|javascript отключен|для просмотра этой страницы|внутренняя ошибка|ошибка сервера|произошла ошибка|что-то пошло не так|попробуйте позже|попробуйте ещё раз|повторите попытку|сервис недоступен|временно недоступен|технические работы|слишком много запросов
找不到頁面|找不到页面|加载失败|載入失敗|不支持 javascript|不支援 javascript|抱歉|對不起|对不起|您訪問的|您访问的|您查看的|暫時無法|暂时无法|伺服器忙碌|服务器繁忙|網站維護|网站维护|找不到|頁面不存在|页面不存在|無此頁面|已被刪除|已被删除|已被移除|無法載入|无法加载|無法連線|无法连接|無權存取|无权访问|訪問受限|访问受限|需要登入|需要登录|登入後|登录后|出現錯誤|出现错误|出錯了|出错了|服務異常|服务异常|連線逾時|连接超时|請重試|请重试|請重新整理|请刷新|需要啟用|需要启用|開啟 javascript|开启 javascript|您的瀏覽器|您的浏览器|您要求的頁面|您请求的页面|不存在或已移除|不存在|無法顯示|无法显示|拒絕存取|拒绝访问|存取被拒|沒有權限|没有权限|請先登入|请先登录|請登入|请登录|登入逾時|会话已过期|請啟用 javascript|请启用 javascript|啟用 javascript|启用 javascript|以檢視此頁面|以查看此页面|伺服器錯誤|服务器错误|內部錯誤|内部错误|發生錯誤|发生错误|系統忙碌中|系统繁忙|請稍後再試|请稍后再试|服務暫停|服务不可用|維護中|维护中|請求過多|请求过多
ページが見つかりません|読み込みに失敗|に失敗しました|javascriptに対応していません|申し訳ございません|申し訳ありません|予期しないエラー|混み合っています|混雑しています|お探しの|ページは存在しません|ページは削除|見つかりませんでした|表示できません|読み込めません|接続できません|アクセスが制限|アクセス権|許可されていません|ログインが必要|ログインし直して|問題が発生|不具合が発生|タイムアウト|やり直してください|再読み込み|更新してください|javascriptが無効|javascript が無効|javascriptを有効|javascript を有効|cookieを有効|cookie を有効|お使いのブラウザ|ご利用のブラウザ|見つかりません|お探しのページ|存在しません|アクセスが拒否されました|アクセスできません|アクセスが集中しています|ただいまアクセス|権限がありません|ログインしてください|セッションの有効期限|セッションが切れました|javascript を有効にしてください|javascriptを有効にしてください|を有効にしてください|このページを表示するには|サーバーエラー|内部エラー|エラーが発生しました|問題が発生しました|しばらくしてから|時間をおいて|もう一度お試しください|再度お試しください|メンテナンス中|サービスは利用できません
pagina non trovata|che stai cercando|che cerchi|la pagina che|non è stata trovata|la pagina richiesta|non esiste|non è disponibile|accesso negato|non autorizzato|effettua l'accesso|accedi per continuare|sessione scaduta|errore interno|errore del server|si è verificato un errore|qualcosa è andato storto|riprova più tardi|riprova|servizio non disponibile|in manutenzione|attiva javascript|abilita javascript|abilitare javascript|javascript è disattivato|javascript è disabilitato|il tuo browser
pagina niet gevonden|die u zoekt|die je zoekt|de pagina die|pagina bestaat|niet gevonden|bestaat niet|niet beschikbaar|toegang geweigerd|geen toegang|log in om|u moet inloggen|sessie is verlopen|er is een fout opgetreden|er ging iets mis|er is iets misgegaan|probeer het later|probeer het opnieuw|onderhoud|schakel javascript in|javascript is uitgeschakeld|uw browser|je browser
nie znaleziono strony|nie znaleziono|strona nie istnieje|brak dostępu|odmowa dostępu|zaloguj się|sesja wygasła|wystąpił błąd|błąd serwera|coś poszło nie tak|spróbuj ponownie|usługa niedostępna|włącz javascript|przeglądarce
"""
#: What notices say around their phrases, in lower case; it makes no notice by itself.
AROUND = """
please|sorry|we're sorry|we are sorry|unfortunately|this page|that page|the page|our site|this site|the site|this website|our website|our servers|the server|this app|this content|this video|this resource|this link|on the server|for this app or website|at this time|right now|at the moment|in a moment|in a few minutes|a few minutes|later|again|your browser|in your browser|your account|your connection|your internet connection|to continue|to see this page|to view this page|to access this page|to view this content|to proceed|for the best experience|for a better experience|turn it on|thank you for your patience|thanks for your patience|we apologize|apologies for the inconvenience|for the inconvenience|you can|go back|back to home|home page|homepage|contact us|contact support|support team|looks like|it looks like|it seems|you are looking for|you're looking for|you requested|you may|you must|you need to|you have to|you will be|redirected|automatically|slow down
bitte|leider|diese seite|die seite|die gesuchte seite|dieser inhalt|dieser dienst|diese anwendung|für diese anwendung|unsere server|der server|zurzeit|derzeit|momentan|in kürze|in wenigen minuten|ihrem browser|in ihrem browser|wir bitten um entschuldigung|entschuldigung|zur startseite|um fortzufahren|um diese seite zu sehen
veuillez|désolé|désolée|cette page|la page|notre site|ce site|ce contenu|votre navigateur|dans votre navigateur|votre compte|pour le moment|plus tard|quelques instants|à nouveau|nous nous excusons|pour continuer|pour voir cette page|pour accéder à cette page
por favor|lo sentimos|vaya|esta página|la página|esa página|este sitio|nuestro sitio|este contenido|su cuenta|tu cuenta|en este momento|más tarde|de nuevo|unos minutos|para continuar|para ver esta página|disculpe las molestias
desculpe|esta página|a página|este site|nosso site|este conteúdo|sua conta|no momento|mais tarde|novamente|alguns minutos|para continuar|para acessar esta página|para ver esta página|pedimos desculpas
пожалуйста|извините|к сожалению|эта страница|этой странице|страница|на сайте|сайт|сейчас|позже|через несколько минут|снова|в браузере|ваш аккаунт|для продолжения|для работы сайта|приносим извинения
请|請|抱歉|对不起|對不起|此页面|此頁面|本页面|本頁面|本网站|本網站|稍后|稍後|目前|浏览器|瀏覽器|您的
申し訳|このページ|本ページ|このサイト|当サイト|現在|ただいま|ください|お使い|ブラウザ|のちほど|後ほど
per favore|spiacenti|questa pagina|questo sito|il tuo account|più tardi|per continuare|helaas|deze pagina|deze website|deze site|later|opnieuw|om door te gaan|proszę|przepraszamy|ta strona|później
"""
#: Phrases of filler text, in lower case.
FILLERS = """
lorem ipsum|dolor sit amet|add description here|add text|hier kommt noch text|kommt noch|text hin|content to be added|text to be added|to be added|is a placeholder|this is a placeholder|placeholder for|your text goes here|add your text here|enter your text here|enter text here|put your text here|add text here|insert content here|insert your content here|your content here|content will go here|text will go here|to be written|to be completed|to be determined|description to follow|description to be added|more content to come|more information coming soon|details to follow|this section is under construction|under construction|your text here|text goes here|replace this paragraph|replace this text|with your own words|description goes here|content goes here|title goes here|click here to edit|click to edit|click to add text|click to add|this is placeholder content|placeholder content|placeholder text|this is placeholder text|this is sample text|this is dummy text|dummy text|sample text|filler text|example text|text to be supplied|to be supplied|text to follow|content coming soon|coming soon|enter a short|add a short description|write something here|type something here|insert text here|blah blah|asdf asdf|qwer|test test
blindtext|platzhaltertext|hier steht später der text|hier steht ihr text|ihr text hier|beispieltext|hier text einfügen|text folgt|dies ist ein platzhalter
votre texte ici|texte à remplacer|texte d'exemple|texte de remplissage|insérez votre texte|faux texte|texte à venir
texto de ejemplo|aquí va su texto|su texto aquí|texto de relleno|escriba aquí su texto|texto pendiente
seu texto aqui|texto de exemplo|texto de preenchimento|insira seu texto|escreva aqui
пример текста|здесь будет текст описания|здесь будет текст|ваш текст здесь|текст-заполнитель|рыбный текст
此處為範例文字|請自行替換|范例文字|範例文字|示例文字|示例文本|此处为示例|占位文字|佔位文字|測試內容|测试内容|內容待補|内容待补
ここにテキストが入ります|ここに文章が入ります|サンプルテキスト|ダミーテキスト|ここに説明を入力|テキストを入力してください
"""
#: Words of the usual filler in Latin, and those of them that no other language uses so.
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
_COMMON = frozenset("sit sed do ut et ad ex ea in eu non qui id est sint elit magna minim culpa dolor esse nulla".split())
_TELLING = sorted(_LATIN - _COMMON)
#: Words that ask to fill something in, by which a bracket is a placeholder.
_ASK = (
    r"insert|enter|fill\s+in|fill\s+out|fill|add|your|type|write|describe|replace|todo|tbd|placeholder|name\s+of|choose|select|to\s+be\s+\w+|text\s+to\s+be|"
    r"hier|bitte|name\s+des|name\s+der|insérer|insérez|saisir|saisissez|indiquer|indiquez|votre|nom\s+d|à\s+compléter|à\s+remplir|"
    r"inserte|insertar|escriba|escribir|rellene|complete|indique|ingrese|su\s+|nombre\s+d|inserir|insira|preencha|preencher|escreva|digite|seu\s+|sua\s+|nome\s+d|"
    r"вставьте|вставить|введите|укажите|заполните|впишите|ваш|название\s+|此處|此处|在此|請填|请填|請輸|请输|填入|填寫|填写|插入|輸入|输入|ここに|入力|記入|挿入"
)
_ASK_END = r"einfügen|eintragen|ergänzen|ausfüllen|einsetzen|eingeben|here|aquí|aqui|ici|hier|здесь|入力|記入|填入|填寫|填写"
#: A line end that no blank line follows: a placeholder may be wrapped, but not reach into another paragraph.
_WRAP = r"\n(?![ \t\r]*\n)"
PLACEHOLDERS = regex.compile(
    rf"""\{{\{{(?:[^{{}}\n]|{_WRAP})*+\}}\}}|\{{%(?:[^%\n]|%(?!\}})|{_WRAP})*+%\}}|<%[=\-]?(?:[^%\n]|%(?!>)|{_WRAP})*+%>|[$\#]\{{(?:[^{{}}\n]|{_WRAP})++\}}|%\([A-Za-z_][\w.]*\)[sdifrx]
|(?<![A-Za-z0-9_%])(?:%[A-Z][A-Z0-9_]++%|%%[A-Z][A-Z0-9_]*+%%)(?![A-Za-z0-9_%])|(?<![A-Za-z0-9_$])\$[A-Z][A-Z0-9_]++\$(?![A-Za-z0-9_$])|@@[A-Za-z_][A-Za-z0-9_.\-]*@@|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*__(?![A-Za-z0-9_])|(?<!<)<<\s*[\p{{L}}_][\w .\-]*+>>(?!>)
|(?<![A-Za-z0-9$\#/\\{{}}^_=.\-])\{{(?:[\p{{L}}_][\w.]*|\d{{1,2}})\}}(?![{{}}])
|\[\[\s*(?i:{_ASK})(?:[^\[\]\n]|{_WRAP})*+\]\]|\[\s*(?i:{_ASK})\b(?:[^\[\]\n]|{_WRAP})*+\](?!\()|\[(?:[^\[\]\n]|{_WRAP})+\s(?i:{_ASK_END})\s*\](?!\()
|(?<![\[A-Za-z0-9_])\[(?!OBJECT\s)[A-Z][A-Z_]*(?:\s[A-Z_]+)+\](?!\()|\[(?:(?:First|Last|Full|Your|Company|Client|Customer|Project|Product|Team|User|Recipient|Sender)\s)+(?:Name|Title|Address|Email|Date|Number|City|Role)\](?!\()|<\s*(?i:{_ASK})(?=[\s_\-])(?:[^<>\n]|{_WRAP})*+>|<(?:[^<>\n/]|{_WRAP})+\s(?i:{_ASK_END})\s*>
|[（［【〈＜]\s*(?:請|请)?(?:在)?(?:此處|此处|這裡|这里|填入|填寫|填写|輸入|输入|插入|ここに)[^（）［］【】〈〉＞\n]*+[）］】〉＞]|[（［【〈＜][^（）［］【】〈〉＞\n]+?(?:を入力|を記入|を挿入|填入|填寫|填写)[^（）［］【】〈〉＞\n]*+[）］】〉＞]""",
    regex.X,
)
#: What placeholders begin with.
OPENERS = "{{ {% { <% << < ${ #{ %( %% % $ @@ __ [[ [ （ ［ 【 〈 ＜"
#: What the lines of traces and statuses, error records and error pages hold, beside the numbers from 400 to 599.
SIGNS = ("traceback", "error", "exception", "<title", "<h1", "fehler", "erreur", "erro", "ошибк", "エラー", "錯誤", "错误", "at ", 'file "', "... ", "=", "raise", "return")
_QUOTED = regex.compile(
    r"(?=[`~\"“„«»‹「『《<])(?:```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|(`+)(?!`).+?(?<!`)\1(?!`)|\"[^\"\n]++\"|“[^”\n]++[”“]|„[^“”\"\n]++[“”\"]|«[^»\n]++»|»[^«\n]++«|‹[^›\n]++›|「[^」\n]++」|『[^』\n]++』|《[^》\n]++》|<(code|pre|blockquote|q)\b[^>]*>.*?</\2>)",
    regex.S | regex.I,
)
_SENTENCE = regex.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
_REPEATED = regex.compile(r"^\W*(?:(?P<w>[\p{L}]{3,})(?:[\s,.;…]+(?P=w)){2,}|(?:x{3,}\s*){2,}|(?P<h>\p{Han}{2})(?P=h){2,}.{0,8}|(?:(?:asdf|qwer|zxcv|hjkl|jkl|qwerty|asdfgh\w*|test|foo|bar|baz|bla|blah)\b\W*){3,})\W*$", regex.I)
_TRACE = regex.compile(
    r"^\s*(?:Traceback \(most recent call last\):|File \"[^\"]+\", line \d+.*|at [\w$.<>]+\(.*\)|(?:Caused by: )?(?:[\w$]+\.)*[A-Z]\w*(?:Error|Exception)\b(?::.*)?|\.{3} \d+ more|Error: E[A-Z]{3,}.*|[a-z]\w*(?:\.\w+)*\s*=\s*[\w.]+\(.*\)|(?:raise|return)\b.*)$",
    regex.I,
)
_JSON_ERROR = regex.compile(r"^\s*\{\s*\"(?:error|errors|message|code|status)\"\s*:.*\}\s*$", regex.S | regex.I)
_HTML_ERROR = regex.compile(r"<(?:title|h1)>[^<]*(?:error|not found|forbidden|denied|bad request|unavailable|timeout|gateway|fehler|erreur|ошибка|エラー|錯誤|错误)[^<]*</(?:title|h1)>", regex.I)
_STATUS = regex.compile(r"^\W*(?:HTTP(?:/[\d.]+)?\s*)?(?:(?:error|fehler|erreur|erro|ошибка|エラー|錯誤|错误|status)\W*)?[45][0-9][0-9]\b\W*(?:error\b)?\W*$", regex.I)
_ERROR_NUMBER = regex.compile(r"\b(?:error|fehler|erreur|erro|ошибка)\s*:?\s*[45]\d\d\b|[エ錯错][ラ誤误]?ー?\s*[45]\d\d|\(?\b[45]\d\d\b\)?|（[45]\d\d）", regex.I)
_IDS = regex.compile(r"\b(?=\w*\d)[0-9a-f]{6,}(?:-[0-9a-f]+)*\b|['\"]?/[\w./\-]+['\"]?|https?://\S+", regex.I)


@cache
def automaton() -> ahocorasick.Automaton:
    """Phrases, openers and signs; a value is (length, kind, whether it stands at word borders only)."""
    found = ahocorasick.Automaton()
    kinds = (
        (NOTICE, NOTICES.replace("\n", "|").split("|")), (FILLER, FILLERS.replace("\n", "|").split("|")), (WEAK, AROUND.replace("\n", "|").split("|")), (OPENER, OPENERS.split()),
        (SIGN, [*SIGNS, *map(str, range(400, 600))]),
    )
    for kind, words in kinds:
        for word in filter(None, words):
            of = found.get(word, ())
            found.add_word(word, (*of, (len(word), kind, kind in (NOTICE, FILLER, WEAK))))
    found.make_automaton()
    return found


def _letters(text: str) -> int:
    return sum(1 for c in text if c.isalnum())


def hits(lower: str) -> tuple[list[tuple[int, int]], ...]:
    """The places of notices, fillers, openers, signs and what stands around notices; lower has one character for each of the text."""
    found: tuple[list, ...] = ([], [], [], [], [])
    for end, values in automaton().iter(lower):
        for n, kind, bordered in values:
            start = end - n + 1
            if bordered:
                if lower[start].isascii() and lower[start].isalnum() and start and lower[start - 1].isalnum() and lower[start - 1].isascii():
                    continue
                if lower[end].isascii() and lower[end].isalnum() and end + 1 < len(lower) and lower[end + 1].isalnum() and lower[end + 1].isascii():
                    continue
            found[kind].append((start, end + 1))
    return found


def _covered(places: list[tuple[int, int]], text: str) -> int:
    """The letters that places cover, each once."""
    total, at = 0, 0
    for start, end in sorted(places):
        start = max(start, at)
        if end > start:
            total += _letters(text[start:end])
            at = end
    return total


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for m in _SENTENCE.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def latin_filler(sentence: str) -> bool:
    """Whether four words in a row, two of them telling, are of the usual filler."""
    run = telling = 0
    for w in _rx(r"[\p{L}']+").findall(sentence.lower()):
        if w in _LATIN:
            run += 1
            telling += w not in _COMMON
            if run >= 4 and telling >= 2:
                return True
        else:
            run = telling = 0
    return False


def has_residue(text: str) -> bool:
    """Whether the document's own text holds a placeholder or filler."""
    own = _QUOTED.sub(" \N{OBJECT REPLACEMENT CHARACTER} ", text)
    low = _lower(own)
    _, fillers, openers, _, _ = hits(low)
    if any(PLACEHOLDERS.match(own, start) for start, _ in openers):
        return True
    latin = any(w in low for w in _TELLING)
    k = 0
    for start, sentence in _pieces(own):
        if not sentence.strip():
            continue
        if _REPEATED.match(sentence.strip("[]<>{}() \t")) or (latin and latin_filler(sentence)):
            return True
        while k < len(fillers) and fillers[k][1] <= start:
            k += 1
        end = start + len(sentence)
        inside = [p for p in fillers[k:] if p[0] < end] if k < len(fillers) and fillers[k][0] < end else []
        if inside:
            letters = max(1, _letters(sentence))
            opening = _letters(sentence[: inside[0][0] - start]) == 0
            if _covered(inside, own) >= SENTENCE_COVERAGE * letters or (opening and _covered(inside, own) >= 0.25 * letters):
                return True
    return False


def is_notice(text: str) -> bool:
    """Whether the document as a whole is an error message or page, or an access or script notice."""
    if _JSON_ERROR.match(text) and _rx(r"\"(?:error|errors)\"\s*:", regex.I).search(text):
        return True
    notices, _, _, signs, around = hits(_lower(text))
    if not notices and not signs:
        return False
    matched = other = 0
    k = j = w = 0
    quoted: list[tuple[int, int]] | None = None
    for start, sentence in _pieces(text):
        line = sentence.strip()
        letters = _letters(line)
        if not letters:
            continue
        while k < len(notices) and notices[k][1] <= start:
            k += 1
        end = start + len(sentence)
        inside = [p for p in notices[k:] if p[0] < end] if k < len(notices) and notices[k][0] < end else []
        while j < len(signs) and signs[j][1] <= start:
            j += 1
        signed = j < len(signs) and signs[j][0] < end
        if signed and (_TRACE.match(line) or _STATUS.match(line) or (_JSON_ERROR.match(line) and '"error' in line.lower()) or ("<" in line and _HTML_ERROR.search(line))):
            matched += letters
            continue
        told = letters - sum(_letters(m.group()) for m in _IDS.finditer(line)) - sum(_letters(m.group()) for m in _ERROR_NUMBER.finditer(line))
        while w < len(around) and around[w][1] <= start:
            w += 1
        covered = 0
        if inside:
            v = w
            while v < len(around) and around[v][0] < end:
                v += 1
            if quoted is None:
                quoted = [m.span() for m in _QUOTED.finditer(text)]
            told_of = any(a < p[1] and p[0] < b for p in inside for a, b in quoted)  # what is quoted has nothing around it
            covered = _covered(inside if told_of else [*inside, *around[w:v]], text)
        if inside and covered >= SENTENCE_COVERAGE * max(1, told):
            matched += letters
        elif told <= 0 or (not inside and len(line) < 80 and len(line.split()) <= 12 and not _rx(r"[.!?。！？:：`#*\-]").search(line) and _is_menu(line)):
            continue
        else:
            other += letters
    return matched > 0 and matched >= DOCUMENT_COVERAGE * (matched + other)


def _is_menu(line: str) -> bool:
    """A line of a page's frame: a few words, alone or between bars."""
    parts = _rx(r"\s*[|•·›»/>]\s*").split(line)
    return all(len(p.split()) <= 2 for p in parts) and not line.startswith("|")


def is_case(text: str | None) -> bool:
    return bool(text) and not text.isspace() and (has_residue(text) or is_notice(text))


def residue(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, has_residue and is_notice of every row; both false for null, empty and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [t.as_py() for t in part.column(1)]
            real = [bool(t) and not t.isspace() for t in texts]
            found = [r and has_residue(t) for r, t in zip(real, texts, strict=True)]
            whole = [r and is_notice(t) for r, t in zip(real, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.bool_()), pa.array(whole, pa.bool_())], names=[id_column, "has_residue", "is_notice"])

    kind = dict(df.dtypes)[id_column]
    return spread(df.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, has_residue boolean, is_notice boolean")


def cases(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column of every document without real content."""
    return residue(df, id_column, text_column).where("has_residue or is_notice").select(id_column).distinct()


def without_cases(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of df that have real content, and those that have none at all."""
    return df.join(cases(df, id_column, text_column), id_column, "left_anti")
