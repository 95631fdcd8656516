"""Hand-written pages and the main text that a reader would take from each; none was made by the trainer's generator."""

PAGES = [
    # plain news
    ("<html><head><title>Daily</title></head><body><div id='nav'><a href='/'>Home</a> <a href='/w'>World</a> <a href='/s'>Sport</a></div><h1>River rises after a week of rain</h1><p>The river rose by two metres on Monday, and officials asked people near the old bridge to leave their homes.</p><p>Schools in the valley will stay closed until Thursday.</p><div id='footer'>Copyright 2020 The Daily</div></body></html>",
     "River rises after a week of rain\nThe river rose by two metres on Monday, and officials asked people near the old bridge to leave their homes.\nSchools in the valley will stay closed until Thursday."),
    # a blog with comments
    ("<body><header><a href='/'>Ann's kitchen</a></header><main><article class='post'><h2>Bread without kneading</h2><p>Mix flour, water, salt and a little yeast in the evening. In the morning the dough has doubled, and you only have to fold it twice.</p><p>Bake it in a closed pot for half an hour.</p></article><section id='comments'><h3>2 comments</h3><div><b>Tom</b><p>I tried this with rye flour and it came out well, thank you for the recipe!</p></div></section></main><footer>Made with love</footer></body>",
     "Bread without kneading\nMix flour, water, salt and a little yeast in the evening. In the morning the dough has doubled, and you only have to fold it twice.\nBake it in a closed pot for half an hour."),
    # one paragraph
    ("<p>Only one sentence stands on this page, and it is the whole text.</p>", "Only one sentence stands on this page, and it is the whole text."),
    ("<article><p>A long sentence of words here, and there.</p></article>", "A long sentence of words here, and there."),
    ("<html><body><main><p>A single paragraph in the main element of a page.</p></main></body></html>", "A single paragraph in the main element of a page."),
    # bare text with breaks
    ("<html><body>The first lines of an old page have no paragraphs at all.<br>They are parted by breaks, and that is all the markup there is.<hr>After the rule the text goes on for a while, as old pages do.</body></html>",
     "The first lines of an old page have no paragraphs at all. They are parted by breaks, and that is all the markup there is.\nAfter the rule the text goes on for a while, as old pages do."),
    # a table layout
    ("<table width=100%><tr><td><a href=1>Start</a><br><a href=2>Links</a><br><a href=3>Guestbook</a></td><td><h1>My stamps</h1><p>I have been collecting stamps since I was nine, and most of them come from my uncle, who was a sailor.</p><p>The oldest one is from 1871.</p></td></tr></table>",
     "My stamps\nI have been collecting stamps since I was nine, and most of them come from my uncle, who was a sailor.\nThe oldest one is from 1871."),
    # German, with a consent box
    ("<body><div class='cookie-banner'><p>Wir verwenden Cookies, um unsere Seite zu verbessern.</p><button>Alle annehmen</button></div><nav><ul><li><a href='#'>Politik</a></li><li><a href='#'>Kultur</a></li></ul></nav><article><h1>Neue Brücke über die Elbe</h1><p>Nach fünf Jahren Bauzeit ist die neue Brücke fertig. Am Sonntag dürfen Fußgänger sie zum ersten Mal betreten.</p><p>Die Kosten lagen bei 80 Millionen Euro.</p></article><footer><p>Impressum &middot; Datenschutz</p></footer></body>",
     "Neue Brücke über die Elbe\nNach fünf Jahren Bauzeit ist die neue Brücke fertig. Am Sonntag dürfen Fußgänger sie zum ersten Mal betreten.\nDie Kosten lagen bei 80 Millionen Euro."),
    # French, references and entities
    ("<div class=menu><a href=/>Accueil</a> | <a href=/c>Contact</a></div><div class=content><h1>L&rsquo;hiver &agrave; Lyon</h1><p>La neige est tomb&eacute;e toute la nuit&nbsp;; les trains ont pris du retard, mais personne ne s&#39;en plaint.</p></div><div class=footer>&copy; 2019</div>",
     "L’hiver à Lyon\nLa neige est tombée toute la nuit ; les trains ont pris du retard, mais personne ne s'en plaint."),
    # Japanese
    ("<html><body><nav><a href='/'>ホーム</a><a href='/news'>ニュース</a></nav><article><h1>桜が咲きました</h1><p>今年の桜は例年より一週間早く咲きました。公園には朝から大勢の人が集まり、写真を撮っていました。</p><p>来週には散り始める見込みです。</p></article></body></html>",
     "桜が咲きました\n今年の桜は例年より一週間早く咲きました。公園には朝から大勢の人が集まり、写真を撮っていました。\n来週には散り始める見込みです。"),
    # Russian, a sidebar
    ("<body><div class='sidebar'><h4>Популярное</h4><ul><li><a href='#'>Погода</a></li><li><a href='#'>Спорт</a></li></ul></div><div class='entry-content'><h1>Музей открылся после ремонта</h1><p>Городской музей снова принимает посетителей. Ремонт длился два года, и за это время коллекция выросла почти вдвое.</p></div></body>",
     "Музей открылся после ремонта\nГородской музей снова принимает посетителей. Ремонт длился два года, и за это время коллекция выросла почти вдвое."),
    # lists and headings
    ("<article><h1>How to plant a tree</h1><p>You need a spade, a bucket and an hour of time.</p><ol><li>Dig a hole twice as wide as the roots.</li><li>Put the tree in and fill the hole with earth.</li><li>Give it a full bucket of water.</li></ol><h2>Afterwards</h2><p>Water it once a week in the first summer.</p></article>",
     "How to plant a tree\nYou need a spade, a bucket and an hour of time.\nDig a hole twice as wide as the roots.\nPut the tree in and fill the hole with earth.\nGive it a full bucket of water.\nAfterwards\nWater it once a week in the first summer."),
    # an advert between paragraphs
    ("<div id='story'><h1>Bees in the city</h1><p>More and more people keep bees on their roofs, and the honey is as good as any from the country.</p><div class='ad'>Buy two jars and pay for one!</div><p>The town hall has had four hives since last spring.</p></div>",
     "Bees in the city\nMore and more people keep bees on their roofs, and the honey is as good as any from the country.\nThe town hall has had four hives since last spring."),
    # a form-wrapped page
    ("<html><body><form id='aspnetForm' method='post'><div class='nav'><ul><li><a href=1>Home</a></li><li><a href=2>Products</a></li></ul></div><div><h1>Annual report</h1><p>The company sold more bicycles than ever before, in particular those with a motor.</p><p>For the coming year the board expects a small increase.</p><p>The full report can be had at the main office in spring.</p></div></form></body></html>",
     "Annual report\nThe company sold more bicycles than ever before, in particular those with a motor.\nFor the coming year the board expects a small increase.\nThe full report can be had at the main office in spring."),
    # recipe with a table
    ("<main><h1>Pancakes</h1><table><tr><td>Flour</td><td>200 g</td></tr><tr><td>Milk</td><td>300 ml</td></tr></table><p>Stir everything until it is smooth and let it rest for twenty minutes before you bake it.</p></main><footer>Recipes of the week</footer>",
     "Pancakes\nFlour\n200 g\nMilk\n300 ml\nStir everything until it is smooth and let it rest for twenty minutes before you bake it."),
    # newsletter box in the article
    ("<article><h1>Night trains are back</h1><p>From December on, sleepers will run between Vienna and Paris three times a week.</p><div class='newsletter'><p>Subscribe to our newsletter.</p><form><input name=mail><button>Send</button></form></div><p>Tickets cost about as much as a night in a hotel.</p></article>",
     "Night trains are back\nFrom December on, sleepers will run between Vienna and Paris three times a week.\nTickets cost about as much as a night in a hotel."),
    # scripts and styles in odd places
    ("<body><p>Before the script there is a paragraph of some length, as you see.<script>document.write('<p>no</p>')</script></p><style>p{color:red}</style><p>After it comes another one, and the style must not show.</p></body>",
     "Before the script there is a paragraph of some length, as you see.\nAfter it comes another one, and the style must not show."),
    # hidden text
    ("<article><p>The visible text of the article is this sentence, which has some words.</p><p style='display:none'>This text was hidden by its author and should stay so.</p><p>The end is visible, too, of course.</p></article>",
     "The visible text of the article is this sentence, which has some words.\nThe end is visible, too, of course."),
    # quotation
    ("<div class='post-body'><h2>On reading</h2><p>He used to say it to everyone who came into the shop:</p><blockquote>Read slowly, or do not read at all.</blockquote><p>Nobody knows where he had it from.</p></div><div class='related'><h3>More</h3><ul><li><a href=1>On writing</a></li><li><a href=2>On sleeping</a></li></ul></div>",
     "On reading\nHe used to say it to everyone who came into the shop:\nRead slowly, or do not read at all.\nNobody knows where he had it from."),
    # footer paragraph without a footer element
    ("<body><h1>Opening hours</h1><p>The library is open from nine to six on weekdays, and until noon on Saturdays.</p><p>&copy; 2021 City of Ulm</p></body>", "Opening hours\nThe library is open from nine to six on weekdays, and until noon on Saturdays."),
    # many wrappers
    ("<div class='page'><div class='wrap'><div class='col'><div><div><h1>Glass from sand</h1><p>Sand, soda and lime are melted at fifteen hundred degrees; what comes out is clear and hard.</p><p>The Romans knew how to do it, and blew it as well.</p></div></div></div></div></div>",
     "Glass from sand\nSand, soda and lime are melted at fifteen hundred degrees; what comes out is clear and hard.\nThe Romans knew how to do it, and blew it as well."),
    # unclosed paragraphs
    ("<html><body><h1>Minutes</h1><p>The meeting began at ten, and all members were present.<p>The treasurer reported that there was enough money for a new roof.<p>The meeting was closed at noon.</body></html>",
     "Minutes\nThe meeting began at ten, and all members were present.\nThe treasurer reported that there was enough money for a new roof.\nThe meeting was closed at noon."),
    # text around
    ("<div class='banner'>Spring sale: everything must go!</div><ul class='breadcrumbs'><li><a href=1>Home</a></li><li><a href=2>Garden</a></li></ul><article><h1>Pruning roses</h1><p>Cut above a bud that looks outwards, at a slant, and never when it freezes.</p></article><aside><h3>Tools</h3><p>Good shears last a lifetime and can be sharpened at home.</p></aside>",
     "Pruning roses\nCut above a bud that looks outwards, at a slant, and never when it freezes."),
    # Spanish, login box
    ("<body><div id='login'><form><label>Usuario</label><input><label>Clave</label><input></form></div><div id='content'><h1>El mercado cambia de lugar</h1><p>Desde el lunes el mercado estará en la plaza mayor, porque la antigua nave necesita un techo nuevo.</p><p>Los horarios no cambian.</p></div></body>",
     "El mercado cambia de lugar\nDesde el lunes el mercado estará en la plaza mayor, porque la antigua nave necesita un techo nuevo.\nLos horarios no cambian."),
    # inline markup
    ("<article><p>Some <b>bold</b> and <i>slanted</i> words, a <a href='/x'>link to a page</a>, and x<sup>2</sup> in one line.</p><p>And <code>a &lt; b</code> in another one, with an <abbr title='t'>abbr</abbr>.</p></article>",
     "Some bold and slanted words, a link to a page, and x2 in one line.\nAnd a < b in another one, with an abbr."),
    # formula
    ("<main><h1>Pythagoras</h1><p>In a right triangle <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is longer than the third side.</p><p>This has been known for a very long time, in many places.</p></main>",
     "Pythagoras\nIn a right triangle a+b is longer than the third side.\nThis has been known for a very long time, in many places."),
    # share buttons
    ("<article><header><h1>Old maps</h1></header><p>The archive has put four thousand old maps online, and they may be used freely by anyone.</p><div class='share'><a href=1>Mail</a> <a href=2>Print</a></div></article>",
     "The archive has put four thousand old maps online, and they may be used freely by anyone."),
    # a page of links and a footer only
    ("<body><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></nav><footer><p>All rights reserved.</p></footer></body>", ""),
    # definition list
    ("<section><h1>Words of the sea</h1><dl><dt>Bow<dd>The front part of a ship, which cuts the water.<dt>Stern<dd>The rear part of a ship, where the rudder is.</dl></section>",
     "Words of the sea\nBow\nThe front part of a ship, which cuts the water.\nStern\nThe rear part of a ship, where the rudder is."),
    # notices and comments around a div
    ("<div class='alert'>Your browser is out of date.</div><div class='text'><p>The mountain hut has beds for thirty people, and in summer one has to book weeks ahead.</p><p>It can be reached in three hours from the village.</p></div><div class='comments'><div class='comment'>We were there in May and it was lovely, with snow on the path.</div></div>",
     "The mountain hut has beds for thirty people, and in summer one has to book weeks ahead.\nIt can be reached in three hours from the village."),
]
