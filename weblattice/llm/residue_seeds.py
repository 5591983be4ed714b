"""Labelled seeds of problem 2: short texts of each class, in the languages of the labelled samples.

Fixed values, from public knowledge only: the printers' filler text, what common page builders put into a new page, and the messages of
common servers, frameworks and interpreters; prose that is like them is of my own wording. Nothing is taken from a corpus.
Placeholders are made by a rule from the marks of common template languages.
"""

FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra, est eros bibendum elit, nec luctus magna felis sollicitudin mauris. Integer in mauris eu nibh euismod gravida.
Duis ac tellus et risus vulputate vehicula. Donec lobortis risus a elit. Etiam tempor. Ut ullamcorper, ligula eu tempor congue, eros est euismod turpis, id tincidunt sapien risus a quam. Maecenas fermentum consequat mi.
Pellentesque malesuada nulla a mi. Duis sapien sem, aliquet nec, commodo eget, consequat quis, neque. Aliquam faucibus, elit ut dictum aliquet, felis nisl adipiscing sapien, sed malesuada diam lacus eget erat.
Cras mollis scelerisque nunc. Nullam arcu. Aliquam consequat. Curabitur augue lorem, dapibus quis, laoreet et, pretium ac, nisi. Aenean magna nisl, mollis quis, molestie eu, feugiat in, orci. In hac habitasse platea dictumst.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor. Sed posuere consectetur est at lobortis.
Welcome to WordPress. This is your first post. Edit or delete it, then start writing! Just another WordPress site.
This is an example page. It's different from a blog post because it will stay in one place and will show up in your site navigation (in most themes).
I'm a paragraph. Click here to add your own text and edit me. It's easy. Just click Edit Text or double click me to add your own content.
Your content goes here. Edit or remove this text inline or in the module Content settings. Your title goes here. Your heading goes here.
Your text here. Add your text here. Add Your Heading Text Here. Click edit button to change this text. Insert text here. Enter text here. Type your text here. Write your text here.
Some quick example text to build on the card title and make up the bulk of the card's content. This is some placeholder content. This is a wider card with supporting text below.
Use this text to share information about your brand with your customers. Describe a product, share announcements, or welcome customers to your store. Example product title. Product description goes here.
Replace this text with your own. Replace this paragraph with your own words. This text is a placeholder. Placeholder text. Sample text. Dummy text. Image caption goes here. Insert image here.
TODO: add content here. TODO: write this section. TBD: text to be written. FIXME: replace the dummy copy. Content to come. Copy to follow. Text to be added later.
Weit hinten, hinter den Wortbergen, fern der Länder Vokalien und Konsonantien leben die Blindtexte. Hier könnte Ihr Text stehen. Klicken Sie hier, um Text einzufügen. Fügen Sie hier Ihren Text ein. Dies ist ein Blindtext. Das ist ein Platzhaltertext.
Ceci est un paragraphe. Cliquez ici pour ajouter votre texte. Insérez votre texte ici. Votre texte ici. Ceci est un texte de remplissage. Ceci est un faux texte.
Haz clic aquí para agregar tu propio texto. Inserte su texto aquí. Escriba aquí su texto. Este es un texto de relleno. Este es un texto de ejemplo.
Fai clic qui per aggiungere il tuo testo. Inserisci qui il testo. Questo è un testo segnaposto. Questo è un testo di esempio.
Clique aqui para adicionar o seu texto. Insira o seu texto aqui. Este é um texto de exemplo. Este é um texto de preenchimento.
Klik hier om je eigen tekst toe te voegen. Voeg hier uw tekst in. Dit is een voorbeeldtekst. Dit is opvultekst.
Нажмите здесь, чтобы добавить свой текст. Введите текст здесь. Вставьте сюда текст. Это пример текста. Это текст-заполнитель.
""".strip().split("\n")  # fmt: skip

NOTICE = """
You need to enable JavaScript to run this app.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
JavaScript is not available. We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.
Please enable JS and disable any ad blocker. Enable JavaScript and cookies to continue. This page requires JavaScript. JavaScript must be enabled in order to use this site. Please turn on JavaScript in your browser and reload the page.
Your browser does not support JavaScript or it is turned off. This site needs JavaScript to work. Loading... Scripts are blocked.
Checking your browser before accessing this site. This process is automatic. Your browser will redirect to your requested content shortly. Please allow up to 5 seconds.
Verify you are human by completing the action below. This site needs to review the security of your connection before proceeding. Just a moment...
Sorry, you have been blocked. You are unable to access this site. This website is using a security service to protect itself from online attacks. Access denied. Error 1020.
You are being rate limited. Too Many Requests. You have sent too many requests in a given amount of time. Please slow down and try again later.
404 Not Found
Not Found The requested URL was not found on this server. Apache Server at localhost Port 80
Forbidden You don't have permission to access this resource. 403 Forbidden
Internal Server Error The server encountered an internal error or misconfiguration and was unable to complete your request. More information about this error may be available in the server error log.
Service Unavailable The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
Proxy Error The proxy server received an invalid response from an upstream server. Bad Gateway. 502 Bad Gateway nginx
Gateway Timeout The gateway did not receive a timely response from the upstream server or application. 504 Gateway Time-out
Bad Request Your browser sent a request that this server could not understand. Gone The requested resource is no longer available on this server and there is no forwarding address.
Unauthorized This server could not verify that you are authorized to access the document requested.
It works! This is the default welcome page used to test the correct operation of the server after installation. You should replace this file before continuing to operate your HTTP server.
Welcome to nginx! If you see this page, the nginx web server is successfully installed and working. Further configuration is required. Thank you for using nginx.
An error occurred. Sorry, the page you are looking for is currently unavailable. Please try again later. If you are the system administrator of this resource then you should check the error log for details.
HTTP Error 404.0 - Not Found The resource you are looking for has been removed, had its name changed, or is temporarily unavailable. HTTP Error 503. The service is unavailable.
HTTP Status 404 - Not Found The origin server did not find a current representation for the target resource or is not willing to disclose that one exists. HTTP Status 500 - Internal Server Error
The requested URL was not found on the server. If you entered the URL manually please check your spelling and try again. Cannot GET /index.html
The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved. We're sorry, but something went wrong.
Page not found. Oops! That page can't be found. It looks like nothing was found at this location. Sorry, this page does not exist. Go to the home page. File not found.
Error establishing a database connection. There has been a critical error on this website. Database error. Could not connect to the database. Too many connections.
Briefly unavailable for scheduled maintenance. Check back in a minute. The site is down for maintenance. We will be back soon. Site under maintenance.
CSRF verification failed. Request aborted. Invalid CSRF token. Your session has expired. Please reload the page and try again. The page has expired due to inactivity. Please refresh and try again.
upstream connect error or disconnect/reset before headers. reset reason: connection failure. no healthy upstream. no live upstreams while connecting to upstream
The requested URL was rejected. Please consult with your administrator. Your support ID is: 1. Request unsuccessful. Incapsula incident ID: 1-1
Too many requests from this IP, please try again after an hour. API rate limit exceeded. You have reached your hourly limit of requests.
Sorry, we couldn't find the page you're looking for. The page you requested is missing. This page is no longer here. Go back to the home page. Take me home.
Account Suspended. This account has been suspended. Contact your hosting provider for more information. This domain has expired. Bandwidth Limit Exceeded. No site is configured at this address.
Error 503 Backend fetch failed. Guru Meditation. 503 Service Unavailable No server is available to handle this request. ERROR The requested URL could not be retrieved.
Fatal error: Uncaught Error: Call to undefined function main() in /var/www/html/index.php on line 12 Stack trace: #0 {main} thrown in /var/www/html/index.php
Warning: include(header.php): failed to open stream: No such file or directory in /var/www/html/index.php on line 3 Parse error: syntax error, unexpected end of file Notice: Undefined variable
Traceback (most recent call last): File "/srv/app/main.py", line 10, in <module> KeyError ValueError: invalid literal ModuleNotFoundError: No module named
Uncaught TypeError: Cannot read properties of undefined (reading 'map') at render (app.js:10:5) at main (app.js:20:3) ReferenceError: window is not defined Unhandled exception
Exception in thread "main" java.lang.NullPointerException at com.example.Main.main(Main.java:10) Caused by: java.io.IOException
Die angeforderte Seite wurde nicht gefunden. Seite nicht gefunden. Fehler 404. Interner Serverfehler. Zugriff verweigert. Sie haben keine Berechtigung, auf diese Seite zuzugreifen.
Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut. Wegen Wartungsarbeiten ist die Seite zurzeit nicht erreichbar. Ein Fehler ist aufgetreten.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen. Diese Seite benötigt JavaScript. JavaScript ist deaktiviert.
La page demandée est introuvable. Page non trouvée. Erreur 404. Erreur interne du serveur. Accès refusé. Vous n'avez pas l'autorisation d'accéder à cette page.
Service temporairement indisponible. Veuillez réessayer plus tard. Le site est en maintenance. Une erreur est survenue.
Veuillez activer JavaScript dans votre navigateur pour continuer. Ce site nécessite JavaScript. JavaScript est désactivé.
No se ha encontrado la página solicitada. Página no encontrada. Error 404. Error interno del servidor. Acceso denegado. No tiene permiso para acceder a esta página.
Servicio no disponible temporalmente. Inténtelo de nuevo más tarde. El sitio está en mantenimiento. Se ha producido un error.
Por favor, active JavaScript en su navegador para continuar. Este sitio requiere JavaScript. JavaScript está desactivado.
Página não encontrada. A página solicitada não existe. Erro interno do servidor. Acesso negado. Serviço temporariamente indisponível. Tente novamente mais tarde. Ative o JavaScript no seu navegador para continuar. Este site requer JavaScript.
Pagina non trovata. La pagina richiesta non esiste. Errore interno del server. Accesso negato. Servizio temporaneamente non disponibile. Riprova più tardi. Abilita JavaScript nel tuo browser per continuare. Questo sito richiede JavaScript.
Pagina niet gevonden. De opgevraagde pagina bestaat niet. Interne serverfout. Toegang geweigerd. De dienst is tijdelijk niet beschikbaar. Probeer het later opnieuw. Schakel JavaScript in om door te gaan. Deze site vereist JavaScript.
Страница не найдена. Запрошенная страница не существует. Ошибка 404. Внутренняя ошибка сервера. Доступ запрещён. Сервис временно недоступен. Повторите попытку позже. Сайт на обслуживании. Пожалуйста, включите JavaScript в браузере, чтобы продолжить. Для работы сайта необходим JavaScript.
""".strip().split("\n")  # fmt: skip

#: Real content that looks like residue: short notes of a site's keeper, sign-in forms, remarks on scripts and faults.
CONTENT = """
We are closed for the winter. Thanks to everyone who wrote to us.
The shop is closed for good. Thank you for all these years.
We moved last week, the new address is on the board.
We have a new home now, please change your links.
The forum takes no new members until further notice.
Only for members, please log in first.
Open every evening except on holidays.
Running since the first of May, kept by one person.
Nothing new this week, see you on Monday.
There are no comments yet, be the first to write one.
Name Password Remember me Log in Create an account Lost your password? Send E-mail User name Repeat password
Wegen Urlaub geschlossen. Danke an alle Leser. Wir sind umgezogen, die neue Adresse steht oben. Nur für Mitglieder, bitte anmelden. Benutzername Passwort Anmelden Registrieren
Fermé jusqu'au printemps. Merci à tous. Nous avons déménagé, voici la nouvelle adresse. Réservé aux membres, connectez-vous. Identifiant Mot de passe Connexion Inscription
Cerrado hasta la primavera. Gracias a todos. Nos hemos mudado, esta es la nueva dirección. Solo para miembros, inicie sesión. Usuario Contraseña Entrar Registrarse
Chiuso fino a primavera. Grazie a tutti. Ci siamo trasferiti, ecco il nuovo indirizzo. Solo per i membri, accedi. Nome utente Password Accedi Registrati
Fechado até à primavera. Obrigado a todos. Mudámos de casa, eis o novo endereço. Só para membros, inicie sessão. Utilizador Palavra-passe Entrar Registar
Gesloten tot het voorjaar. Dank aan allen. Wij zijn verhuisd, dit is het nieuwe adres. Alleen voor leden, meld u aan. Gebruikersnaam Wachtwoord Aanmelden Registreren
Закрыто до весны. Спасибо всем. Мы переехали, вот новый адрес. Только для участников, войдите. Имя Пароль Войти Регистрация
Every page here can be read without JavaScript.
JavaScript is optional on this site: without it you only miss the clock.
I distrust sites that ask for scripts before they show a single word.
We use no scripts, and we ask our readers to switch them off.
We were offline yesterday while a disk was replaced, and all is back now.
The maintenance last night took longer than we had planned.
The mistake in last week's guide has been corrected, thanks to those who wrote in.
The result is undefined when the list is empty, so check it first.
The contract is null and void if either side keeps silent.
""".strip().split("\n")  # fmt: skip

#: Prose that speaks of residue or quotes it.
MENTION = """
In most template languages you write {{ user }} and the engine puts the name of the reader there.
Our site's templates are plain files: where {{ value }} is written the renderer puts in what the page passes to it.
The manual says that <%= title %> prints a value while {% if user %} only tests it.
The start script in ${HOME}/etc is run by the shell when the machine comes up, the one in ${PREFIX}/bin when someone logs in.
With ${HOME} the shell puts in the path of your folder, and $PATH lists where it looks for programs.
The phrase lorem ipsum has been used by printers as dummy text since the sixteenth century.
This article explains where lorem ipsum comes from and why designers fill their drafts with it.
In a format string such as %s or %d each mark stands for one value, as the guide explains.
A placeholder such as %NAME% or {name} stands for a value that the program fills in later.
If you see the words 404 Not Found, the document explains, the server has no file of that name.
In der Vorlage schreibt man {{ name }}, und das Programm setzt dort den Wert ein, erklärt das Handbuch.
Dans le modèle on écrit {{ name }} et le moteur y met la valeur, explique le manuel.
En la plantilla se escribe {{ name }} y el motor pone ahí el valor, explica la guía.
Nel modello si scrive {{ name }} e il motore vi mette il valore, spiega il manuale.
No modelo escreve-se {{ name }} e o motor coloca ali o valor, explica o manual.
In het sjabloon schrijf je {{ name }} en het programma vult daar de waarde in, zegt de handleiding.
В шаблоне пишут {{ name }}, и программа подставляет туда значение, объясняет руководство.
""".strip().split("\n")  # fmt: skip

#: The marks between which template languages have what is to be filled in.
MARKS = (("{{", "}}"), ("{%", "%}"), ("{", "}"), ("<%=", "%>"), ("<%", "%>"), ("${", "}"), ("#{", "}"), ("%%", "%%"), ("%", "%"), ("[[", "]]"), ("__", "__"), ("@@", "@@"), ("<!--#", "-->"), ("<?php", "?>"), ("<?=", "?>"))
#: What stands for no value in the output of common languages, and unfilled fields of letters.
VALUES = ("undefined", "null", "NaN", "[object Object]", "[insert x]", "[your x]", "[enter x here]", "[First Name]", "[Company Name]", "%s", "%d")
#: Where a page has what is filled in.
PLACES = ("Dear @,", "Hello @!", "Welcome, @", "© @", "Posted by @ on @", "Title: @", "Price: @", "Total: @", "Last login: @ @", "Contact us at @", "@", "@ | @", "Copyright @ All rights reserved.")


def placeholders() -> list[str]:
    """Each placeholder, whose name is always x, alone and in each place."""
    marked = [f"{a}{gap}x{gap}{b}" for a, b in MARKS for gap in ("", " ")]
    return [place.replace("@", x) for place in ("@ ", *PLACES) for x in (*marked, *VALUES)]
