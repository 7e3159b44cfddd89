"""What the residue models are trained on: usual wordings of filler, of notices and of forms, and of people who write about
them, in six languages. {a|b} stands for either; `expanded` takes each alternative in turn."""

from __future__ import annotations

import builtins
import re
from http import HTTPStatus

# The usual filler words of printers.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisici elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum vestibulum ante ipsum primis in faucibus orci luctus ultrices posuere "
    "cubilia curae donec vitae pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas "
    "nam libero justo laoreet sit amet cursus eget nunc scelerisque viverra mauris aliquam sem fringilla"
).split()

# The passage that the filler words come from, as printers use it too, and ordinary words of the language.
LATIN = """
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur vel illum qui dolorem eum fugiat quo voluptas nulla pariatur.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae.
Itaque earum rerum hic tenetur a sapiente delectus ut aut reiciendis voluptatibus maiores alias consequatur aut perferendis doloribus asperiores repellat.
Terra caelum aqua ignis ventus flumen mons silva arbor flos fructus herba campus hortus porta murus turris urbs forum templum via pons navis portus mare litus insula unda.
Puer puella vir femina mater pater filius filia frater soror amicus hostis rex regina dux miles servus dominus magister discipulus poeta nauta agricola populus senatus.
Bonus malus magnus parvus longus brevis altus latus novus vetus pulcher clarus obscurus albus niger ruber viridis caeruleus calidus frigidus siccus umidus durus mollis gravis levis celer tardus.
Amat videt audit dicit facit venit currit stat sedet iacet portat capit mittit vincit regit scribit legit docet discit laborat dormit vivit moritur gaudet dolet timet sperat.
Quidquid quoniam quamquam simul semper saepe numquam interdum tandem deinde postea antea hodie cras heri nunc tunc iam etiam quoque tamen igitur itaque nam enim autem vero.
Viridem montem silvarum umbras fluminibus ventorum caelorum terrarum animalium hominibus rusticus urbanus capitur captus ventum orbem orbis terrarum praeter propter contra apud inter.
""".strip().split("\n")

FILLER = """
{Sample|Dummy|Example|Placeholder|Filler|Demo|Default} {text|content|paragraph|heading|title|copy|description} {goes here|comes here|to be replaced|for this section|, please replace|, please ignore|, remove before publishing}.
{Enter|Type|Insert|Add|Put|Write|Paste} {your|the|a short} {text|content|description|message|title|summary|bio|comment} {here|in this box|in this field}{.||...}
{Click|Double-click|Tap} here to {add|edit|enter} {your own text|text|a description|a title|content}.
{Text|Content|Description|Details|Image|Caption} {to follow|coming soon|pending|to come|will follow|not yet available}.
{Your|My} {text|headline|title|description|company name|tagline|message} {goes here|here}{.|}
{This|Here} is {some|a|an} {dummy|placeholder|sample|example|filler} {text|paragraph|content|entry}{.|, please change it.|, do not publish.}
{TODO|FIXME|XXX|TBC}: {write|add|replace|fill in|update|insert} {this section|this text|the body|the final text|the real content|copy from client}{.| before launch.| later.}
{To be|Will be} {announced|determined|confirmed|completed|written|supplied}{.| later.| (draft).}
{TBD|TBC|TBA|N/A|XXX}{.|, TBD.| - to be filled in| TBC| TBA TBA| TBD TBD| XXX}
{[|(}{placeholder|PLACEHOLDER|Placeholder|draft}{: |, | for } {text|copy|image|content} {to be supplied|pending|will come later|follows later}{]|)}
{test|testing|blah|foo bar|xxx|qwerty|asdf jkl|abc abc} {test|testing|blah|baz|xxx|uiop|asdf jkl|abc abc} {test|123|blah|qux|xxx|qwerty|jkl|abc}
{[|<|(}{insert|enter|your|add|type|put} {name|title|topic|date|text|city|address|company|order number|subject|phone|email|link|user name}{ here||}{]|>|)}
{[|<|(}{Insert|Enter|YOUR|Your|INSERT|ENTER} {Name|TITLE|NAME|Topic|CITY|Company|Date|ORDER NUMBER|Subject|ADDRESS|Link|USER NAME}{ Here| HERE|}{]|>|)}
{[|(}{Hier|Bitte} {Namen|Betreff|Datum|Ort} {einfügen|eintragen|einsetzen}{]|)}
{[|(}{insérer|votre|saisir} {nom|ville|sujet|prénom|date}{ ici|}{]|)}
{[|(}{inserte|su|escriba} {nombre|ciudad|asunto|fecha}{ aquí|}{]|)}
{[|(}{вставьте|ваше|введите} {имя|город|тему|дату}{ сюда|}{]|)}
{[|(}{name|city|title|date|subject|number|link|user name|first name} to be {added|filled in|confirmed|announced|inserted}{]|)}
{NAME|CITY|EMAIL|TITLE|ORDER_NO|USER|DATE|FIRST_NAME}_{PLACEHOLDER|PLACEHOLDER|HERE|TO_FILL}
{Text|Inhalt|Bild|Beschreibung} {folgt|folgt noch|kommt noch|in Arbeit}{.| - |, bitte Geduld.}
{Texte|Image|Contenu|Description} {à venir|à suivre|en attente}{.| - |, merci de patienter.}
{asdf|qwer|zxcv|qwertz|sdfg|hjkl} {asdf|qwer|yxcv|jkl|fdsa} {asdf|qwer|zxcv|jkl|uiop} {asdf|qwer|asdf}
{Untitled|New|Blank} {document|post|page|section|article}
{The|This} {quick brown fox jumps over the lazy dog|page is under construction|section is intentionally left blank|page has been left empty on purpose}.
{Hier|An dieser Stelle} {steht|erscheint|kommt|folgt} {bald|später|demnächst|noch} {der|ein|Ihr|dein} {Text|Inhalt|Beitrag|Titel}.
{Das|Dies} ist ein {Platzhaltertext|Beispieltext|Mustertext|Fülltext|Typoblindtext}{.|, bitte ändern.|, bitte austauschen.}
{Platzhalter|Mustertext|Testtext|Beispieltext} {für den Text|zum Ersetzen|für Inhalt|, noch zu ersetzen}.
{Geben Sie hier|Gib hier|Tragen Sie hier} {Ihren|deinen|einen} {Text|Titel|Inhalt} ein.
{Text|Inhalt|Beschreibung} {fehlt noch|wird nachgereicht|folgt in Kürze|kommt später}.
{Saisissez|Entrez|Ajoutez|Écrivez} {ici votre|votre|le} {texte|contenu|titre|message} {ici|.}
{Ceci est un|Voici un} {texte de remplissage|texte fictif|faux texte|texte provisoire|exemple de texte}{.|, merci de le remplacer.|, à changer.}
{Contenu|Texte|Description|Titre} {à compléter|à rédiger|provisoire|à remplir|bientôt disponible}.
{Escriba|Introduzca|Añade|Inserta} {aquí su|aquí tu|el} {texto|contenido|título|mensaje}{.| aquí.}
{Este es un|Esto es un} {texto de relleno|texto de prueba|texto simulado|texto provisional}{.|, hay que cambiarlo.|, reemplácelo.}
{Contenido|Texto|Descripción|Título} {de muestra|pendiente|por definir|de prueba|próximamente}{.|, sustituya este texto.}
{Введите|Вставьте|Добавьте|Напишите} {здесь|сюда} {ваш|свой|основной} {текст|заголовок|контент|комментарий}.
{Это|Здесь} {текст-заполнитель|пример текста|текст-рыба|временный текст|образец текста}{.|, замените его.|, удалите его.}
{Описание|Содержание|Текст|Заголовок} {будет добавлено позже|скоро появится|в разработке|ещё не готов}.
{ここに|この欄に} {テキスト|文章|タイトル|説明文|内容} を {入れて|記入して|追加して|入力して} ください。
{これは|こちらは} {仮のテキスト|見本の文章|ダミー文章|例文|テスト用の文章} です。{|後で差し替えます。}
{本文|内容|説明|詳細} は {後日|準備中|未定|近日公開} です。
""".strip().split("\n")

NOTICES = """
{Please|You must|You need to|To continue,} {enable|turn on|activate|allow|switch on} {JavaScript|scripts|JS|cookies|JavaScript and cookies} {to see|to use|to load|to read|to open|in order to display|for} this {site|application|article|topic|form|page|content|feature|thread|message}.
{JavaScript|Scripting|Active scripting|Cookie support} {is|seems to be|appears to be} {disabled|turned off|blocked|not enabled|not available|unavailable} {in|by|on} your {browser|device|web browser}.
{Scripts|Cookies|JavaScript and cookies|A newer browser} {are|is} {required|needed|necessary} {to display|to show|to load|for} {this page|the article|all replies|the content}.
{JS|Java Script|Scripting} {must be|has to be|needs to be} {on|enabled|allowed} {for this page|to go on|to see more}.
{This|The} {page|website|application|forum|viewer|content} {requires|needs|will not work without|cannot be displayed without|depends on} {JavaScript|scripts|a browser with JavaScript|scripting to be on}.
{Your|The} browser {does not support|has disabled|is blocking|cannot run} {JavaScript|scripts|this feature|the required scripts}.
{We're sorry but|Sorry,} this {app|site|page} {doesn't work properly without JavaScript|needs scripts to run}. {Please enable it to continue|Enable it and try again}.
{Verifying|Checking} {that you are human|your connection|your browser|the security of your connection}{...|. This may take a few seconds.|, please wait.}
{Please|Kindly} {disable|turn off|pause} your {ad blocker|ad-blocking extension|content blocker} {and refresh|and reload the page|to continue}.
{Please|Kindly} {complete the captcha|solve the captcha|confirm you are not a robot} {to continue|to proceed}.
{Switch off|Pause|Remove} {any|all|your} ad {blocker|blockers}{ and reload| and try again|, then continue| for this site}.
{Your|The} {session|login|token} {has expired|expired|is no longer valid}, {please sign in again|log in once more}.
{Votre|La} session {a expiré|n’est plus valide}, {veuillez vous identifier à nouveau|merci de vous reconnecter}.
{Su|La} sesión {ha expirado|ha caducado}, {vuelva a entrar|inicie sesión otra vez}.
{Ваша сессия|Сессия} {истекла|завершена}, {войдите заново|выполните вход ещё раз}.
{セッション|ログイン} の {有効期限が切れました|時間が過ぎました}。{再度ログインしてください|もう一度ログインしてください}。
{只今|現在} {サーバー|サイト} {に接続できない状態です|が応答しません}。
{Your|The} browser is {out of date|not supported|no longer supported|too old} {and cannot show this page|. Please upgrade|and some content may be missing}.
{The|This} {page|resource|document|file|article|topic|thread|address} {you are looking for|you were looking for|you requested|you tried to open|requested} {could not be found|was not found|does not exist|has been moved|is no longer available|cannot be displayed|is unavailable}.
{We|Sorry, we|Oops! We} {can't|couldn't|could not|were unable to} {find|load|open|display|retrieve} {that page|this page|the content|the page you wanted|the requested resource|your data}.
{Oops|Whoops|Uh-oh|Sorry}{!|,} {something|it looks like something} {went wrong|is broken|has gone wrong} {on our end|on our side|here|while loading the page}.
{An|A|Sorry, an} {unexpected|internal|unknown|application|server|critical|unhandled} {error|exception|problem} {has occurred|occurred|was encountered} {while handling your request|during execution|on the server|while loading this page}.
{The|This} {server|service|site|system|host|application|website} is {currently|temporarily} {unavailable|offline|overloaded|down for scheduled maintenance|not responding|undergoing maintenance}. {Please try again later|Please check back soon|Try again in a few minutes}.
{We are|We're} {currently|temporarily} {experiencing technical difficulties|performing maintenance|having trouble with our servers}. {Please check back shortly|Please come back later|Thank you for your patience}.
{The|Your} {connection|request|session|operation} {timed out|has timed out|was refused|was reset|was aborted|has expired|was blocked}. {Please retry|Please log in again|Try refreshing the page|Please reload}.
{Could not|Unable to|Failed to|Cannot} {connect to|reach|open|query|contact|load} {the database|MySQL server|database server|the backend|the upstream server|remote host|the requested page}{.|: connection refused.|, error code 2002.}
{Connection|Connecting} to the {database|server|backend} {failed|lost|timed out}: {too many open connections|errno 111|unknown host|try later}
{Database|Template|Rendering|Gateway|Proxy|Query|SQL|Server|Script} error: {connection refused|too many connections|cannot render the view|table does not exist|query failed|unable to resolve host}.
{Rate|Request|Usage} limit {exceeded|reached}. {Too many requests|Please slow down|Retry after 60 seconds}.
{You|Your account} {do not have|does not have|lack the} {permission|the right|the privileges|sufficient rights} to {access|view|open|see} {this page|this resource|this forum|the requested page|this content}.
{You must|Please|You need to} {log in|sign in|register|be a member} to {view this page|see this content|access this forum|continue reading}.
{Access|Permission|Request} {refused|to this page denied|forbidden|blocked}{: your address has been blocked.|. Reference number: 18.5c|. Contact the administrator.}
{Go|Click here to go|Return} {back to the homepage|to the start page|to the previous page|back} or {try again|contact support|contact the webmaster|refresh this page}.
{If|When} {the problem|this error} {persists|continues}, {please contact|notify|write to} {the site administrator|the webmaster|support|your hosting provider}.
{Warning|Notice}: {undefined|Undefined} {index|variable|array key|offset} {"id"|"user"|'name'|: title} in /{srv/www|var/www|home/www}/{list|forum|user|topic}.php on line {27|416|90}
{Error|Fatal error|Warning|Notice|Deprecated|Parse error}: {Uncaught exception|Undefined variable|Undefined index|Undefined offset|Division by zero|Cannot modify header information|Call to a member function on null|Maximum execution time of 30 seconds exceeded|Allowed memory size exhausted|syntax error, unexpected token} in /{var/www/html|home/site/public|usr/share/app|opt/web}/{index|template|functions|config|post}.php on line {12|48|105|301}
  File "/{usr/lib/python3|app|opt/web|home/www}/{main|server|handlers|models|utils}.py", line {7|58|210}, in {main|handle|get|render|load}
at {com.example.web|org.apache.catalina|java.lang.Thread|System.Web.UI|org.springframework.web}.{run|doGet|invoke|process|render}({Server|Thread|Handler|Page|Filter}.java:{52|748|1190})
{Exception in thread "main"|Caused by:|Unhandled exception:|Uncaught} {java.lang.IllegalStateException|java.io.IOException|java.sql.SQLException|java.lang.RuntimeException|System.NullReferenceException|ReferenceError|TypeError}: {null|connection closed|is not defined|cannot read properties of undefined|index out of bounds|Object reference not set to an instance of an object}
{Traceback (most recent call last):|Stack trace:|Call stack:|Debug information:|Error details:}
{HTTP|Server|Error|Status} {code|error|status}{:|} {400|401|403|404|408|410|429|500|502|503|504}
{Apache|nginx|openresty|Microsoft-IIS|lighttpd|cloudflare|Varnish cache server}{/2.4.41 (Ubuntu) Server at localhost Port 80|/1.18.0|| Request ID: 7f3a}
{Ray ID|Request ID|Incident ID|Error code|Reference}: {7d0f3a92be|0x80004005|ERR_CONNECTION_RESET|DNS_PROBE_FINISHED_NXDOMAIN|18.2f}
{Bitte|Sie müssen|Du musst} {JavaScript|Skripte|Cookies|JavaScript und Cookies} {aktivieren|einschalten|zulassen|erlauben}, um {die Seite zu nutzen|diesen Inhalt zu sehen|fortzufahren|das Forum zu lesen|den Text zu laden}.
{JavaScript|Scripting|Die Ausführung von Skripten} ist in {Ihrem|deinem} Browser {deaktiviert|ausgeschaltet|blockiert|nicht aktiviert}.
{Für|Zur} {diese Seite|diesen Dienst|die Anzeige|die Darstellung dieser Seite} {wird JavaScript benötigt|ist JavaScript erforderlich|müssen Skripte erlaubt sein}.
{Die|Diese} {angeforderte|gesuchte|aufgerufene|von Ihnen gewünschte} {Seite|Datei|Ressource|Adresse} {wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|wurde verschoben|ist nicht mehr verfügbar|kann nicht angezeigt werden}.
{Leider|Entschuldigung, es|Es} ist {ein unerwarteter|ein interner|ein unbekannter|ein technischer} Fehler {aufgetreten|passiert|beim Laden aufgetreten}. {Bitte versuchen Sie es später noch einmal|Bitte laden Sie die Seite neu|Wir arbeiten daran}.
{Der|Dieser} {Server|Dienst|Webserver|Zugang} ist {derzeit|zurzeit|im Moment|momentan} {nicht verfügbar|überlastet|wegen Wartungsarbeiten abgeschaltet|nicht erreichbar}.
{Sie haben|Du hast} {keine Berechtigung|keinen Zugriff|nicht die nötigen Rechte}, {diese Seite aufzurufen|diesen Inhalt anzusehen|auf diese Seite zuzugreifen}.
{Fehler|Fehlercode|Serverfehler} {400|403|404|500|502|503}: {Datei nicht vorhanden|Zugriff nicht erlaubt|Dienst nicht verfügbar|Zeitüberschreitung|ungültige Anfrage|Seite existiert nicht}.
{Verbindung zur Datenbank|Datenbankverbindung|Verbindung zum Server} {fehlgeschlagen|konnte nicht hergestellt werden|unterbrochen}.
{Ihre|Deine} {Sitzung|Anmeldung} ist {abgelaufen|ungültig}. {Bitte neu anmelden|Bitte melden Sie sich wieder an}.
{Merci d’|Merci d'|Veuillez |Vous devez }{activer|autoriser} {JavaScript|les scripts|les cookies} pour {voir cette page|continuer|utiliser ce site|lire ce message|accéder au forum}.
{JavaScript|L’exécution des scripts|Le JavaScript} est {désactivé|bloqué|nécessaire} {dans votre navigateur|sur votre appareil|pour afficher cette page}.
{Ce site|Cette application|Ce contenu} {a besoin de JavaScript|ne fonctionne pas sans JavaScript|requiert un navigateur avec scripts}.
{La|Cette} {page|ressource|rubrique|fiche} {demandée|recherchée|que vous cherchez} {n’existe pas|n'existe plus|a été déplacée|n’a pas pu être trouvée|n'est plus disponible|ne peut pas être affichée}.
{Désolé, une|Une} erreur {interne|inattendue|inconnue|technique} {s’est produite|est survenue lors du chargement|a empêché l’affichage}. {Veuillez réessayer plus tard|Merci de recharger la page|Contactez l’administrateur}.
{Le|Notre} {serveur|service|site} est {actuellement|temporairement} {indisponible|en maintenance|surchargé|inaccessible}.
{Vous n’avez pas|Vous n'avez pas} {l’autorisation|les droits nécessaires|la permission} {d’accéder à cette page|de voir ce contenu|de consulter ce forum}.
{Erreur|Code d’erreur|Erreur serveur} {400|403|404|500|502|503} : {document non trouvé|accès interdit|service indisponible|délai dépassé|requête invalide|la page n’existe pas}.
{Connexion à la base de données|La connexion au serveur|L’accès à la base} {impossible|a échoué|a été refusé}.
{Por favor,|Debe|Tienes que|Es necesario} {active|habilitar|activar|permitir} {JavaScript|los scripts|las cookies} para {continuar|ver la página|usar este sitio|leer este tema|cargar el contenido}.
{JavaScript|La ejecución de scripts|El soporte de scripts} está {desactivado|deshabilitado|bloqueado} en {su|tu} {navegador|dispositivo}.
{Este sitio|Esta aplicación|Este contenido} {necesita JavaScript|no funciona sin JavaScript|requiere un navegador con scripts}.
{La|Esta} {página|dirección|sección|entrada} {que busca|solicitada|que intenta abrir|que buscas} {no se encuentra|no existe|ya no está disponible|ha sido movida|no pudo ser encontrada|no se puede mostrar}.
{Lo sentimos, se|Se|Vaya, se} ha producido un error {inesperado|interno|desconocido|al cargar la página}. {Inténtelo de nuevo más tarde|Vuelva a intentarlo|Recargue la página}.
{El|Nuestro} {servidor|servicio|sitio} {está en mantenimiento|no está disponible en este momento|está sobrecargado|no responde}.
{No tiene|Usted no tiene|No tienes} {autorización|permisos suficientes|acceso} para {acceder a esta página|ver este contenido|entrar en este foro}.
{Error|Código de error|Error del servidor} {400|403|404|500|502|503}: {archivo no encontrado|acceso prohibido|servicio no disponible|tiempo de espera agotado|solicitud incorrecta|la página no existe}.
{No se pudo|Imposible|Error al} {abrir la base de datos|establecer la conexión|conectar con el servidor}.
{Пожалуйста, |Необходимо |Чтобы продолжить, |Вам нужно }{включите|включить|разрешите|активируйте} {JavaScript|скрипты|cookies|поддержку скриптов} {в браузере|в настройках браузера|для работы сайта|для доступа к странице}.
{JavaScript|Поддержка скриптов|Выполнение скриптов} {отключён|отключена|заблокировано|не работает} в вашем браузере.
{Этот сайт|Эта страница|Приложение} {не работает без JavaScript|требует включённых скриптов|нуждается в поддержке скриптов}.
{Запрошенная|Запрашиваемая|Указанная} страница {не существует|была удалена|не найдена|недоступна|перемещена|не может быть показана}.
{К сожалению, произошла|Произошла|Возникла} {внутренняя|непредвиденная|неизвестная|техническая} ошибка{.| при загрузке страницы.| сервера.} {Повторите попытку позже|Попробуйте обновить страницу|Мы уже работаем над этим}.
{Сервер|Сайт|Сервис} {временно|сейчас} {недоступен|перегружен|на техническом обслуживании|не отвечает}.
{У вас нет|Недостаточно} {прав для просмотра|доступа к|разрешения на просмотр} {этой страницы|этого раздела|содержимого}.
{Ошибка|Код ошибки|Ошибка сервера} {400|403|404|500|502|503}: {файл не найден|доступ запрещен|сервис недоступен|время ожидания истекло|неверный запрос}.
{Не удалось|Невозможно|Ошибка при попытке} {подключиться к базе данных|соединиться с сервером|установить соединение}.
{JavaScript|スクリプト|クッキー} {を有効にして|をオンにして|を許可して} {ください|から再読み込みしてください|からもう一度お試しください}。
{お使いの|ご利用の} ブラウザ {では JavaScript が無効になっています|はスクリプトに対応していません|ではこのページを表示できません}。
{このサイト|このアプリ|このコンテンツ} {を利用するには JavaScript が必要です|はスクリプトがないと動作しません|の表示には JavaScript が必要です}。
{指定された|リクエストされた|アクセスした} {ページ|ファイル|URL} {は存在しません|は削除されました|は移動しました|が見つかりません|は表示できません}。
{申し訳ありません|大変申し訳ございません}。{予期しない|内部|システム} エラーが発生しました。{後でもう一度お試しください|管理者にお問い合わせください|ページを再読み込みしてください}。
{サーバー|サービス|サイト} {は現在メンテナンス中です|が混み合っています|に接続できませんでした|は一時的に利用できません}。
{このページ|このフォーラム|このコンテンツ} {を閲覧する権限がありません|へのアクセスは許可されていません|を見るにはログインが必要です}。
{エラーコード|サーバーエラー|エラー} {400|403|404|500|502|503}: {リクエストが不正です|アクセス禁止|タイムアウトしました|ファイルがありません}
""".strip("\n").split("\n")

#: Names of fields, as forms have them.
FIELDS = (
    "username user_name first_name firstname last_name surname name full_name email phone date time day city country address street zip company order_no "
    "order_id customer_id item_id topic title subject message recipient sender link url reset_url user.name user.email post.title post.date "
    "amount price total number code token password "
    "Vorname Nachname Anrede Ort Betreff Datum Kundennummer prenom nom ville sujet nombre apellido ciudad asunto fecha имя фамилия город тема 名前 氏名 件名 日付"
).split() + ["first name", "last name", "order number", "full name", "email address", "your name", "Your Name"]

#: Marks of template languages that follow no rule: name stands for the field's name as it is, NAME for it in capitals, Name for capital initials.
OTHER_MARKS = """
${name}
#{name}
@{name}
&{name}
%{name}
$name$
$(name)
$(NAME)
#(name)
%(name)s
{{#name}}{{/name}}
{L_NAME}
<%= name %>
<%= NAME %>
<?= $name ?>
{{ name | default }}
*|NAME|*
|*NAME*|
(name to be inserted)
YOUR_NAME
NAME_HERE
NAME_PLACEHOLDER
""".strip().split("\n")


def marks() -> list[str]:
    """Marks by rule: a name between the same one or two signs (question marks: two or four), or in one to three brackets, with and without a sign or blanks inside; and the others."""
    out = list(OTHER_MARKS)
    for sign in "%$#@_~?":
        for n in (2, 4) if sign == "?" else (1, 2):
            if n > 1 or sign in "%$#@":
                out += [sign * n + name + sign * n for name in ("NAME", "name")]
    for left, right in ("{}", "[]", "<>", "()"):
        for n in (1, 2, 3):
            inner = ("", " ") if n > 1 or left == "{" else ()
            out += [left * n + x + name + x + right * n for x in inner for name in ("name", "NAME", "Name")]
            if n < 3:
                out += [left * n + x + y + name + y + x + right * n for x in "%$#!~*?@" for y in ("", " ") for name in ("name", "NAME") if left != "("]
                out += [left + x + name + right for x in "$!#@%" for name in ("name", "NAME") if left == "{"]
        if left in "[<":
            out += [left + x + right for x in ("NAME", "Name")] + [left + verb + " " + x + right for verb, x in (("YOUR", "NAME"), ("Your", "Name"), ("insert", "name"), ("Insert", "Name"))]
    return list(dict.fromkeys(out))


#: What scripts print for what they do not have.
UNFILLED = """
{Hello|Hi|Dear|Welcome|Welcome back} {undefined|null|NaN|None}{,|!|.}
{You have|There are} {undefined|NaN|null} {new messages|unread notifications|items|replies|points}.
{Posted|Written|Last edited|Sent} {by|on|at} {undefined|null|NaN|Invalid Date}{.|}
{undefined|null|NaN|[object Object]} {undefined|null|NaN|[object Object]}
{Your|The} {order|balance|last login|appointment|subscription} {is|was|was on|ends on} {undefined|null|NaN|Invalid Date}.
{Total|Price|Amount|Date|Name}: {undefined|null|NaN|Invalid Date|[object Object]}
{Shown|Valid|Updated} on {undefined|null|NaN}/{undefined|NaN|null}/{NaN|undefined|null}.
{Members of|Topics in|Results for} {undefined|null} {in|by|from} {null|undefined} on {undefined/NaN/undefined|NaN/NaN/NaN|null}.
{Rated today|Topic closed|By admin|Last reply}, {undefined|null|NaN} {comments|views|replies|likes}.
{Page|Showing} {NaN|undefined|null} of {NaN|undefined|null}
{Hallo|Bonjour|Hola|Привет} {undefined|null|NaN}{,|!}
""".strip().split("\n")

#: Prose about such things, not residue.
PROSE = """
{I|We} {keep getting|always get|sometimes see|got} {a 404|a 500|an error page|a timeout} when {I|we} {open|load|refresh} the {site|archive|link|wiki}, {any ideas|is it just me|does it work for you}?
{The|That} {error page|login form|script warning|stack trace} {went away|came back|was gone} after {a restart|I cleared the cache|the update|we renewed the certificate}.
{Does|Did} anyone {else|here} {know|understand} what {the error|this message|undefined|a bad gateway} means in {this case|the log|that tool}?
{I|My colleague} {turned on|switched off|had to enable} {scripts|JavaScript|cookies} and {then it loaded|the table showed up|nothing changed}.
{We|They} {used|pasted|printed} {lorem ipsum|dummy text|placeholder text|a sample text} {to test the layout|for the draft|in the first version} and {forgot about it|nobody noticed|replaced it later}.
{The|My} {template|newsletter|form letter} {had|showed|still contained} a {placeholder|field|variable} {that nobody filled|in the greeting|instead of my name}, {which was funny|so we fixed the export}.
{My|Our|The old} {browser|server|laptop|database|site|account} {was|is|has been} {too slow|too old|fine|down|moved} {since|until|before|after} {the update|last week|we changed it|the move}, {so I installed another one|which we found out later|but nobody complained|and now it works}.
{Turn on|Switch on|Allow|Switch off} {scripts|JavaScript|cookies} in the {browser|options|preferences|menu} and {try again|it loads|you will see the list}, {that fixed it for me|worked for a friend|no need to reinstall}.
{Your|My} {header|script|template|mail|command} {needs|wants|lacks} {a name|the number|quotes|one more field} {there|at the end|in the first line}.
{Dieses Thema|Der Beitrag|Die Antwort} wurde {gelöscht|verschoben|geschlossen}, {oder du hast keinen Zugriff darauf|der Admin hat es gesehen|frag die Moderation}.
{Please|Could you} {send|show|give} {me|us} {the file|the log|your settings|the page} {again|once more}, {the last one|my copy|the old link} {could not be opened|was empty|did not load|is gone}.
{Thanks|Great|OK}, {the page|that|it|the login} {loads|works|opens} {now|again|here}, {it was the proxy|I had forgotten the filter|no idea why|you were right}.
{We|They|The admins} {restarted|moved|upgraded|replaced} {the server|the machine|the database|the disk} {on Friday|last night|this morning} and {everything is back|it has been quiet|the list is empty now}.
{Try|I tried} {again with fewer files|another browser|the new version|it without the option}, {it worked for me|that helped|same result}.
{I|We} {have to leave now|will look tomorrow|asked the admin}, {more|the rest|an example} follows in {my next post|a minute|another thread}.
{Der Server|Die Seite|Der Rechner} {lief|war|ist} {gestern noch|heute|seit Montag} {langsam|da|weg|wieder da}, {keine Ahnung warum|wir haben ihn neu gestartet|danke euch}.
{Ich|Wir} {frage|schauen} {morgen|später} {den Admin|noch einmal}, {die Datei|der Zugang} {fehlt mir|war leer}.
{Je vais|On va} {demander|regarder} {l’accès au dossier|le fichier|la page} {demain|plus tard}, {merci|sinon dites-le moi}.
{Le serveur|La page|Mon navigateur} {était lent|marche|a changé} {hier|depuis lundi|maintenant}, {je ne sais pas pourquoi|c’était le câble}.
{El servidor|La página|Mi navegador} {iba lento|funciona|cambió} {ayer|desde el lunes|ahora}, {no sé por qué|era el cable|gracias a todos}.
{Сервер|Сайт|Мой браузер} {перезагрузили|работал медленно|обновили} {вчера|утром|в пятницу}, {теперь всё работает|не знаю почему|спасибо}.
{サーバー|ページ|ブラウザ} を {再起動したら|更新したら|変えたら} {直りました|動きました|遅くなりました}。
{[|(|}{post|message|comment|thread|topic} {deleted|removed|hidden} {by author|by user|by moderator|by its author|by staff}{]|)|.}
{[|(}{deleted|removed|edited|hidden|withdrawn}{]|)}
{[|(|}{Beitrag|Thema|Antwort} {gelöscht|entfernt|ausgeblendet|wurde vom Autor gelöscht}{]|)|.}
{[|(|}{message|sujet|réponse} {supprimé|effacé|masqué par la modération|retiré par son auteur}{]|)|.}
{[|(|}{mensaje|tema|respuesta} {eliminado|borrado|oculto por moderación|retirado por su autor}{]|)|.}
{[|(|}{сообщение|тема|ответ} {удалено|скрыто|удалено автором|удалено модератором}{]|)|.}
{[|（|}{投稿|返信|スレッド} {は削除されました|は非表示です|を投稿者が消しました}{]|）|。}
{Do|Why do} {I|we|you} {need|have to allow} {scripts|JavaScript|cookies} {for|to see} {the chart|that page|the preview}, or {is plain HTML enough|can I skip it}?
{Same|The same} {problem|error|thing} {here|for me|with our server}, {since Friday|again today|for the second time}, {a restart helped|no idea why|any fix}?
{The|Our} {job|queue|disk|proxy|mirror|web server} {gave up|was full|was slow|died} {again|for an hour|last night}, so {the page|everybody} {showed|got} {a bad gateway|an internal server error|a permission denied|service unavailable}.
{It|Mine|The run|That lane} {takes|ends after|is number|has} {404|500|403|502} {minutes|seconds|reads|files}, {no joke|as always|so be patient}.
{Ich habe|Wir haben|Man muss} {JavaScript|Skripte|Cookies} {eingeschaltet|ausgeschaltet|aktiviert|blockiert}, {danach ging es|jetzt lädt es|und die Grafik war da|aber es half nicht}.
{Nach dem|Beim} {Einschalten|Aktivieren|Neuladen|Neustart} {lief|ging|kam} {die Grafik|alles|die Liste} {wieder|nicht mehr}, {komisch|zum Glück}.
{Gleicher Fehler|Dasselbe Problem|Gleiches Verhalten} {hier|bei uns|auf dem alten Rechner}, {seit gestern|seit dem Update}.
{Du hast|Man hat} {keine Rechte|keinen Zugriff} auf {den Ordner|das alte Thema}, {frag den Admin|das war schon immer so}.
{J’ai|Nous avons} {activé|désactivé|bloqué} {JavaScript|les scripts|les cookies} et {le graphique s’affiche|rien n’a changé}.
{Même problème|Même erreur} {ici|chez nous}, {depuis lundi|depuis la mise à jour}.
{He|Hemos} {activado|desactivado} {JavaScript|los scripts} y {ahora carga|sigue igual}.
{El mismo|Mismo} {problema|error} {aquí|en nuestro servidor}, {desde ayer|desde el cambio}.
{Я включил|Мы отключили} {JavaScript|скрипты} и {график появился|ничего не изменилось}.
{Та же|Такая же} {ошибка|проблема} {у нас|на старом сервере}, {со вчерашнего дня|после обновления}.
{JavaScript|スクリプト} を {オンにしたら|切ったら} {グラフが出ました|直りました|変わりませんでした}。
{Bei mir|Gestern} {kam|kommt|erschien} {ein 404|eine Fehlerseite|ein Serverfehler}, {nach einem Neustart ging es|geht es bei euch}?
{J’ai|On a} {une erreur 404|une page d’erreur|un message bizarre} {depuis hier|quand j’ouvre le lien|sur le vieux site}, {et vous|c’est normal}?
{Me sale|Ayer salió} {un error 404|una página de error|un aviso raro} {cuando abro el enlace|desde ayer|al cargar la lista}, {a alguien más le pasa|ya se arregló}?
{У меня|Вчера} {выскочила|появилась|висит} {ошибка 404|страница с ошибкой|надпись об ошибке}, {после перезапуска прошло|у всех так}?
{昨日から|リンクを開くと} {404 になります|エラーになります|変な表示が出ます}が、{皆さんはどうですか|再起動で直りました}。
""".strip().split("\n")

#: Sentences of letters and pages that a program fills in; @ is a field.
FILLED = """
{Dear|Hi|Hello|Hey|Good day|Welcome} @{,|!|}
{Dear|Hello} {Mr|Mrs|Dr|customer|member} @{,|:}
{Thank you|Thanks} for {your order|your purchase|registering|contacting us|signing up}, @{.|!}
{Your|The} {order|parcel|invoice|ticket|booking|request|subscription|payment} {number @|@|no. @} {has been received|was confirmed|is being processed|will arrive on @|was sent to @|expires on @}.
{You|We} {signed up|registered|logged in|wrote to us} {on @|as @|with @|from @}.
{Please|Kindly} {click @|visit @|call @|reply to @|use the code @} {to confirm|to reset your password|to unsubscribe|for details}.
{We|Our team} {will contact you|have sent a mail|will deliver} {at @|to @|on @}.
{Congratulations|Happy birthday|Welcome back|Good news}, @!
{Regards|Sincerely|Best wishes|Yours|Cheers},{| } @
{Subject|To|From|Date|Name|Re|Order|Amount|Address|Phone|Author|Title}: @
{Posted|Written|Created|Published} by @ {on @|in @|at @}
{Welcome|Welcome back} to @{, @|.|!}
@ {has sent you a message|wrote on @|has invited you to @|is waiting for your reply|, your parcel is ready|, we have news for you}{.|!}
@{ |, |: |. }{We are happy to have you here|Find our offers below|See what is new this week|Bitte beachten Sie unsere Hinweise|Nous avons le plaisir de vous écrire|Le damos la bienvenida|Мы рады видеть вас}.
{Our shop opens soon.|Here are your results.|All the best for you.|Bis bald bei uns.|À bientôt chez nous.|Hasta pronto.|До встречи.|またのご利用をお待ちしております。} @
{Yes|Agreed|Same here|+1|Bump|Thanks again|Exactly|Right}{,|} @{.|!|}
{Guten Tag|Guten Morgen|Moin|Servus|Grüezi} {Frau @|Herr @|@}{,|!}
{Buenos días|Buenas tardes|Buenas noches|Saludos} {señora @|don @|@}{,|:}
{Bonsoir|Salut|Coucou|Bonne journée} {Monsieur @|Madame @|@}{,|!}
{Доброе утро|Добрый день|Приветствую} @{,|!}
{Liebe|Lieber|Hallo|Guten Abend|Sehr geehrte|Sehr geehrter} {Frau @|Herr @|@|Kunde @}{,|!}
{Ihre|Deine} {Bestellung|Anfrage|Rechnung|Buchung} {@|Nr. @|vom @} {ist eingegangen|wurde bestätigt|wird bearbeitet|trifft am @ ein}.
{Danke|Vielen Dank} {für Ihre Nachricht|für deine Bestellung|für die Anmeldung}, @.
{Viele Grüße|Mit besten Grüßen|Freundliche Grüße}{,|} @
{Cher|Chère|Bonjour|Monsieur|Madame} @{,|}
{Votre|La} {commande|demande|facture|réservation} {@|n° @|du @} {a bien été reçue|est confirmée|sera livrée le @}.
{Merci|Merci beaucoup} {pour votre message|de votre inscription}, @.
{Cordialement|Bien à vous}, @
{Estimada|Estimado|Hola|Querido} {cliente @|señor @|@}{,|:}
{Su|Tu} {pedido|solicitud|factura|reserva} {@|n.º @|del @} {ha sido recibido|está confirmado|llegará el @}.
{Gracias|Muchas gracias} {por su mensaje|por registrarte}, @.
{Saludos|Atentamente}, @
{Уважаемая|Уважаемый|Добрый вечер|Дорогой|Здравствуйте} @{,|!}
{Ваш|Ваша} {заказ|заявка|счёт|запрос} {@|№ @|от @} {принят|подтверждён|будет доставлен @|получена}.
{Спасибо|Благодарим} {за заказ|за регистрацию|за сообщение}, @.
{С уважением|Всего доброго}, @
@ {さん|さま|様}{、|、こんにちは|、お世話になっております}
{ご注文|お問い合わせ|ご予約}{番号 @| @ } {を受け付けました|を確認しました|を発送いたします}。
{ご登録|お申し込み}ありがとうございます、@ {様|さん}。
{件名|宛先|日時|氏名}: @
""".strip().split("\n")

#: Sentences of people who write about marks; @ is one that they name.
NAMED = """
{Use|Write|Put|Type|Enter|Add} @ {in the template|in the config|in the header|where the name goes|with two braces|as a default} {and it works|otherwise it fails|and the engine fills it|, not the plain name}.
{Replace|Change|Swap} @ {with|by|for} {your own value|the real name|the path|@} {before you run it|in the script|and retry}.
{The|My|Our} {script|parser|template|mail|letter|log|table|export|newsletter} {still shows|printed|had|ignores|contains|prints|left} @ {instead of the name|in every line|in the greeting|at the top|for each sample|when the value is missing}.
{What|Why} {does|is} @ {mean|for|printed|not replaced|left in the output}{?| here?| in this file?}
{Does anyone|Do you} know {how @ is expanded|what @ stands for|why @ stays in the text}?
{The|This} {variable|field|tag|token|placeholder|option|macro|argument|column} @ {is not set|is empty|was never replaced|is undefined|does nothing|comes from the sheet}{.| for me.| in my case.}
{I|We|He|She|Someone} {set|got|saw|found|typed|defined|escaped|used|forgot} @ {in the loop|in the mail|to the folder|as the file name|in the subject line|in my output} {and|but} {it renders fine|nothing changed|had to laugh|it was ignored}.
{In|With} {the shell|Jinja|the mailer|PHP|LaTeX|the old tool}{,|} @ {is a variable|has to be escaped|expands to the path|means the default}.
{My|Our} @ {library|run|file|kit|script} {behaves the same|has the same problem|looks fine}.
{A|The} {literal|single|stray|second} @ {breaks the regex|confuses the parser|is fine|gets eaten}.
{then|but|and} {the page|the site|it|the window|the reply} {said|says|showed|shows} @ {and|for an hour|until|so|, then}
{He|She|Someone|They|I} {pasted|typed|copied|printed|read|quoted} {a page of|a line of|the words|the text|the} @ {to|as|in|and|for} {test|the|a|see}
{I|We} {get|got|see|saw|had} {a|an|the|this} @ {when|on|from|for|after|again}
{It|That} {says|said|prints|reads|shows} @ {when|if|because} {the value is null|I open it|the sheet was empty}.
{Schreib|Setz|Nimm} @ {in die Vorlage|in den Kopf|als Namen}, {sonst wird es ignoriert|dann klappt es}.
{Im Betreff|In der Mail|In der Datei} {stand|steht} {noch|immer} @ {statt meines Namens|drin}.
{Die Variable|Das Feld|Der Platzhalter} @ {ist nicht gesetzt|ist leer|wird nicht ersetzt}.
{Was bedeutet|Wofür steht} @ {in der Ausgabe|hier}?
{Écris|Mets|Utilise} @ {dans le modèle|dans l’en-tête}, {sinon c’est ignoré|et ça marche}.
{La variable|Le champ|Le mot} @ {est vide|n’est pas remplacé|reste dans le texte}.
{Le courriel|Le fichier|La lettre} {contenait|affiche} @ {au lieu de mon nom|partout}.
{Escribe|Pon|Usa} @ {en la plantilla|en la cabecera}, {si no se ignora|y funciona}.
{La variable|El campo|La etiqueta} @ {está vacía|no se reemplaza|queda en el texto}.
{El correo|El archivo} {traía|muestra} @ {en lugar de mi nombre|en cada línea}.
{Пиши|Поставь|Используй} @ {в шаблоне|в заголовке}, {иначе не работает|и всё заработает}.
{Переменная|Поле|Метка} @ {не задана|пустое|не заменяется}.
{В письме|В файле} {было|стоит} @ {вместо имени|в каждой строке}.
{テンプレート|ヘッダー|設定} {に @ と書いて|で @ を使って} {ください|みました}。
{変数|項目|タグ} @ {が空です|が置き換わりません|は設定されていません}。
{メール|ファイル} {に @ と書いてありました|で @ のままでした}。
""".strip().split("\n")

#: Words after which someone tells what was seen.
TELLING = (
    "said says say saying reads read shows show showed shown got get gets getting sees see saw seen called calls typed wrote writes pasted printed prints "
    "displays displayed error message page line words replied answered turn turned enable enabled "
    "sagt sagte meldet meldete steht stand zeigt zeigte schreibt schrieb Meldung Seite "
    "dit disait affiche affichait montre écrit message erreur dice decía muestra salió sale mensaje error "
    "пишет писал показывает показал сообщение сообщил выдаёт"
).split()

_CHOICE = re.compile(r"\{([^{}]*)\}")


def expanded(lines: list[str], each: int = 1) -> list[str]:
    """Lines with every alternative at least `each` times; where a line has several choices they turn at different speeds."""
    out = []
    for line in lines:
        choices = [m[1].split("|") for m in _CHOICE.finditer(line)]
        n = each * max((len(c) for c in choices), default=1)
        for i in range(n):
            turn = iter(range(len(choices)))
            out.append(_CHOICE.sub(lambda m, i=i, turn=turn: (lambda k: choices[k][(i * (k % 3 + 1) + i // len(choices[k]) + k) % len(choices[k])])(next(turn)), line))
    # No blanks between words of scripts that have none.
    return list(dict.fromkeys(re.sub("(?<=[\u3001-\u30ff\u4e00-\u9fff]) (?=[\u3001-\u30ff\u4e00-\u9fff])", "", x) for x in out))


def status_lines() -> list[str]:
    """The reason phrases of the HTTP standard, as servers print them, and the names of exceptions."""
    out = []
    for s in HTTPStatus:
        if s >= 400:
            out += [f"{s.value} {s.phrase}", f"HTTP Error {s.value}: {s.phrase}", f"{s.phrase} - {s.description}." if s.description else s.phrase]
    names = sorted(n for n in dir(builtins) if n.endswith("Error"))
    return out + [f"{n}: {x}" for n, x in zip(names, ["invalid argument", "object has no attribute 'id'", "list index out of range", "'body'", "not found", "unsupported operand"] * len(names), strict=False)]
