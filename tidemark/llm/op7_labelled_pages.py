"""Small labelled table for the block classifier: invented pages whose main blocks carry ``data-main``."""

PAGES = (
    """<html><head><title>Harbour news</title></head><body><header><div class="logo">Harbour Post</div>
<nav><ul><li><a href=1>Home</a></li><li><a href=2>World</a></li><li><a href=3>Sport</a></li><li><a href=4>Weather today</a></li></ul></nav></header>
<article><h1 data-main>New pier opens after long delay</h1><p data-main>The new pier opened on Monday morning after a delay of almost
three years, and several hundred people came to see the first ferry leave for the islands.</p><p data-main>"It was worth it."</p>
<p data-main>Engineers had to replace two of the <a href=5>concrete pillars</a> that were damaged in a storm last winter, which cost the town more than planned.</p>
<p data-main>Rain.</p><h2 data-main>What comes next</h2><ul><li data-main>A second ferry line in spring</li><li data-main>Bicycle parking</li></ul>
<p data-main>The mayor said that the remaining work on the quay would be done before summer and that the old pier would be taken down in the autumn.</p></article>
<aside><h3>Most read</h3><ul><li><a href=6>Ten walks along the coast that you should try this year</a></li><li><a href=7>Fish prices rise again</a></li></ul></aside>
<footer><p>Copyright Harbour Post. All rights reserved. Reproduction only with permission of the publisher.</p><a href=8>Imprint</a></footer></body></html>""",
    """<body><div class="cookie-notice"><p>We use cookies to give you the best experience on this site. By going on you agree to our use of cookies as described in the policy.</p><button>Accept</button></div>
<div id="menu"><a href=a>Start</a> <a href=b>Recipes</a> <a href=c>About us</a></div>
<div id="content"><h1 data-main>Bread with three flours</h1><p data-main>This bread keeps for a week and needs little work. The dough rests over night in a cool place and is baked in a hot pot in the morning.</p>
<p data-main>Mix the flours with water and wait for an hour.</p><p data-main>Add salt and yeast, then fold the dough four times with half an hour between the folds, until it is smooth and springs back when touched.</p>
<p data-main>Bake.</p><p data-main>After forty minutes take the lid off the pot and bake on until the crust is dark brown and sounds hollow when you knock on it.</p></div>
<div class="ad">Buy our new mixer now and save twenty percent on all bowls until Sunday.</div>
<div class="comments"><h3>Comments</h3><p>I tried it yesterday and it came out very well, thank you for the recipe, my whole family liked it a lot.</p><p>Great!</p></div>
<form><label>Your name</label><input><p>Subscribe to the newsletter to get a new recipe every week in your mailbox, free of charge.</p></form>
<div class="footer">Contact and imprint</div></body>""",
    """<body><div><a href=1>Forum</a> | <a href=2>Members</a> | <a href=3>Search the board</a></div>
<div><div><p data-main>I have been looking for a way to fix the leaking valve on the old pump for weeks, and in the end it was only a worn ring that had to be changed.</p>
<p data-main>For all who have the same trouble: take the cover off first, then turn the valve to the left until it stops, and lift it out with both hands.</p>
<p data-main>Be careful with the spring.</p><p data-main>There is <a href=8>a drawing of all parts</a> of it.</p><p data-main>The new ring costs next to nothing and can be had in any shop for bathroom parts, so don't pay for the whole set as I did at first.</p></div></div>
<div><a href=9>Older thread about pumps</a> <a href=10>Newer thread about pipes</a> <a href=11>Report this post</a></div><div><a href=12>Terms of use</a> <a href=13>Privacy</a></div></body>""",
    """<body><nav class="breadcrumb"><a href=1>Home</a> / <a href=2>Science</a></nav><main><article><header><h1 data-main>Bees count to four</h1></header>
<p data-main>Bees can count up to four when they look for food, a study shows. The animals had learnt to fly past a number of yellow marks before they found sugar.</p>
<p data-main>See the <a href=3>full study with all tables</a>.</p><p data-main>The result is in line with what is known about other insects and birds with small brains, the group writes in its report.</p>
<div class="share"><a href=4>Share</a><a href=5>Send</a></div><div class="advert"><p>Honey from the mountains, three jars for the price of two, only this week in our shop around the corner.</p></div>
<p data-main>How they do it is open.</p><section class="related"><h2>Related</h2><p><a href=6>Why wasps build with paper and what engineers can learn from their nests</a></p></section></article></main>
<section id="comments"><article class="comment"><p>My uncle keeps bees and says that he has known this for more than thirty years, nobody had to do a study.</p></article></section>
<footer>&copy; 2020 Science weekly, a paper for all who ask</footer></body>""",
    """<body><div role="banner">Town library</div><div class="sidebar"><p>Open Monday to Friday from nine to six, on Saturdays from ten to two, closed on Sundays and on public holidays.</p></div>
<div class="post"><h2 data-main>Reading week</h2><p data-main>In the last week of May children can borrow as many books as they like and keep them until the end of the summer holidays.</p>
<p data-main>Every evening at six somebody reads aloud from a favourite book.</p><p data-main>No tickets needed.</p></div>
<div class="notice">The lift is out of order until further notice, please use the stairs at the back of the building.</div>
<div class="modal"><p>Join the friends of the library today and help us to buy new books for the children of our town.</p></div></body>""",
    """<body class="no-sidebar has-header"><div class="page-with-sidebar"><div class="top"><a href=1>Garden club</a> <a href=2>Calendar</a> <a href=3>Shop</a></div>
<div class="col"><h1 data-main>Roses in a dry summer</h1><p data-main>Water the roses early in the morning and only at the root, since wet leaves in the sun burn and fall ill within a few days.</p>
<p data-main>Mulch helps.</p><p data-main>A layer of bark as thick as a hand keeps the soil cool and moist, so that the plants need water only twice a week even in July.</p>
<p data-main>Cut what has withered.</p></div><div class="sidebar"><p>The club meets on the first Tuesday of every month in the old school, guests are welcome and pay nothing.</p><p><a href=4>Become a member</a></p></div>
<div class="foot-links"><a href=5>Imprint</a> <a href=6>Privacy</a></div></div></body>""",
    """<body><div class="search-results-page"><article><p data-main>Words found in the letters of the clerk are given here with the page and the line on which they stand, as far as they can be read.</p>
<p data-main>Most letters are lost.</p><p data-main>Those that are kept lie in a box in the archive of the town, in no order, and some of them are torn.</p></article>
<div class="search-box"><p>Type a word and press the key to look for it in all letters.</p></div></div></body>""",
    """<body><form id="aspnetForm"><table><tr><td><a href=1>Home</a></td><td><a href=2>Tariffs</a></td><td><a href=3>Forms and leaflets</a></td></tr></table>
<table><tr><td><p data-main>From the first of January the water works charge by the cubic metre and no longer by the size of the house, as the council decided last week.</p>
<p data-main>Meters are read once a year.</p><p data-main>Whoever has no meter yet gets one free of charge until the end of the year, and a letter with the date of the visit will come in time.</p></td></tr></table>
<table><tr><td>Water works, Bridge Street 4</td><td><a href=4>Contact</a></td><td><a href=5>Data protection</a></td></tr></table></form></body>""",
    """<body><div><a href=1>Start</a></div><div><a href=2>Pictures</a></div><div><a href=3>Guest book</a></div><div data-main>My trip to the north began on a grey morning in May with a bag that was much too heavy and boots that were much too new.</div>
<div data-main>After two days my feet hurt so much that I sat down by the road, and <a href=4>a farmer</a> took me along to the next village on a cart full of hay.</div>
<div data-main>It rained.</div><div data-main>In the village I stayed for a week, learned to mend nets and to row, and left with lighter luggage and a better mood.</div>
<div><a href=5>Part two of the trip</a></div><div>Made by hand in 2003</div><div><a href=6>Write to me</a></div><div>Visitors so far 1204</div><div><a href=7>Up</a></div></body>""",
    """<body><header><a href=1>Daily</a></header><main><article><h1 data-main>Bridge closed</h1><p data-main>The bridge at the mill is closed from Monday for two weeks.</p><p data-main>Buses go round by the station.</p></article></main>
<div id="comments"><h3>Four comments</h3><p>Again! They closed it in spring already and nobody told us why it took so long to get one board changed.</p>
<p>I have to go round by the station every day now, which costs me half an hour, and the bus is always full.</p><p>Thanks for telling us in time.</p>
<p>Why not build a new one at last, this one is older than my grandmother and she is ninety and walks better than it stands.</p></div></body>""",
    """<body><nav><a href=1>News</a> <a href=2>Culture</a></nav><div class="content"><article class="post type-post category-music tag-popular"><header class="post-header"><h1 data-main>The choir sings again</h1></header>
<div class="entry-content"><p data-main>After a year without rehearsals the choir of the harbour workers will sing again on Sunday, in the open air and at a distance.</p><p data-main>Entry is free.</p><p data-main><a href=9>Programme of the evening</a></p>
<ul><li data-main>Songs of the sea</li><li data-main>Two new pieces by a member of the choir who writes under another name</li></ul></div></article></div>
<div class="sidebar"><article class="teaser"><h3>Theatre</h3><p>The new play is about a clock maker who stops all clocks of the town.</p></article><article class="teaser"><h3>Film</h3><p>Three short films from the north are shown on Friday night.</p></article></div></body>""",
    """<body><div><h1 data-main>How to oil a door</h1><p data-main>A door that squeaks needs one drop of oil on each hinge and nothing more, whatever the neighbours say.</p><p data-main>Move it a few times.</p></div>
<div><h3>More from this site</h3><p><a href=1>Why old windows should be kept and how they are made tight for the winter</a></p><p><a href=2>Ten things that you can do with a rope and two hooks in a small flat</a></p>
<p><a href=3>What a carpenter would never buy</a></p></div></body>""",
    """<body><p data-main>Only this one sentence stands on the page.</p></body>""",
    """<body><div class="notice-board"><h1 data-main>Notice of the harbour master</h1><p data-main>Ships of more than forty metres wait outside until a pilot has come on board, by day and by night.</p><p data-main>No exceptions.</p></div>
<p><a href=1>All notices</a></p></body>""",
    """<body><div id="gdpr-consent"><h2>Your privacy</h2><p>We and our partners store and read information on your device, such as cookies, and process personal data in order to show content, to measure it and to learn about those who see it, and you can change your choice at any time.</p></div>
<div class="article-body"><h1 data-main>Snow in June</h1><p data-main>It snowed.</p><p data-main>For the first time in ninety years the fields above the village were white in June, and the cows came down by themselves.</p></div>
<div class="social-share">Tell your friends</div><div class="related-posts"><p>Hail in May broke all windows of the glass house.</p></div></body>""",
    """<body><div class="wrapper"><div class="col-left"><p><a href=1>Lathes</a></p><p><a href=2>Drills</a></p><p><a href=3>Saws for wood and for metal</a></p></div><div class="col-mid"><h1 data-main>Lathe L20</h1>
<p data-main>The lathe turns pieces of up to twenty centimetres and can be put on any table that does not shake.</p><p data-main>See also <a href=7>the larger lathe</a> here.</p><p data-main>Weight: 31 kg</p><p data-main>Colour: green</p>
<p data-main>It comes with three knives, a chuck with four jaws and a book that explains every step with drawings.</p></div>
<div class="col-right"><p><a href=4>Basket</a></p><p>Empty</p><p><a href=5>Till</a></p><p>Free delivery</p><p><a href=6>Return</a></p></div></div></body>""",
    """<body><header><a href=1>Town hall</a></header><form action="/x"><h1 data-main>Waste paper</h1><p data-main>From March the waste paper is fetched on every second Friday and no longer on Wednesdays, since the yard in the valley is closed.</p>
<p data-main>Put it out by six.</p><p data-main>Boxes must be flat and tied together, and wet paper stays where it is, as the machine that sorts it can not deal with it.</p>
<p data-main>Books are fetched too.</p></form><footer><a href=2>Imprint</a></footer></body>""",
    """<body><p><a href=1>Front page</a></p><div class="popular"><h1 data-main>A song that all know</h1><p data-main>The song was written in one night by a baker who could not sleep, and he sold it for a sack of flour to the man from the fair.</p>
<p data-main>Today it is sung in eleven languages, mostly with other words, and nobody remembers the baker but the people of his street.</p><p data-main>They sing it at noon.</p></div><p><a href=2>Next song</a></p></body>""",
    """<body><div class="box-ad"><p>The best boots for the mountains, now with soles that hold on wet stone as well as on dry, at half the price.</p></div><ul><li><a href=1>Maps</a></li><li><a href=2>Huts</a></li></ul>
<div class="text"><h2 data-main>Over the pass</h2><p data-main>The way over the pass takes six hours for those who walk well, and there is water at two places only.</p><p data-main>Start early.</p></div>
<div class="post-comments"><p>We were up there last week and found no water at all at the second place, so take enough with you when you go.</p></div><p><a href=3>Next tour</a></p>
<div class="newsletter-box"><p>Get one tour a week by mail, with a map and the times of the buses, from April to October.</p></div><p><a href=4>Archive</a></p></body>""",
    """<body><nav><a href=1>All posts</a></nav><article class="post hentry category-town tag-social format-standard"><h1 data-main>Benches</h1><p data-main>The town puts up ten new benches along the river before Easter.</p>
<p data-main>They are made of oak.</p><p data-main><a href=2>Map with all benches</a></p></article><div id="comments"><p>Ten are too few, on a warm evening there are a hundred people there and all of them want to sit down somewhere near the water.</p>
<p>Last time the wood was gone after one winter, so let us hope that somebody looks after these at night, oak burns well as we know.</p><p>Nice!</p></div></body>""",
    """<body><div class="layout has-sidebar wide"><h2 data-main>Low tide</h2><p data-main>At low tide you can walk over to the island in less than an hour, but only with a guide.</p><p data-main>Take warm socks.</p></div>
<div class="widget"><h3>Guides</h3><p>Anna walks on Mondays and on Fridays, she speaks four languages and has been over more than a thousand times in all kinds of weather.</p>
<p>Piet walks every day but likes to talk, so you should not be in a hurry when you go with him, and bring something to eat.</p><p>Prices on request.</p></div><p><a href=1>Tides</a></p></body>""",
    """<body><header><a href=1>Advice</a></header><article><h1 data-main>How to apply for a garden</h1><p data-main>Gardens by the canal are given out twice a year, and whoever wants one has to ask before the end of January.</p>
<section class="form-section"><h2 data-main>The sheet</h2><p data-main>The sheet has two pages, of which the second is for those who share a garden with their neighbours or with a school.</p><p data-main>Sign both.</p></section>
<section class="search-guide"><p data-main>To find a free garden look at the board by the gate, where numbers without a name are those that nobody has yet.</p><p data-main>Numbers change.</p></section>
<div class="newsletter-box"><p>Get one letter a month with all gardens that have become free and with tips for the season, at no cost.</p></div>
<p data-main>Those who get none stand first on the list of the next year, which is why it is worth to ask even in a bad one.</p></article>
<section class="reader-opinions"><h3>What readers say</h3><p>I have asked for six years now and still have none, while a man in our street has got two of them.</p><p>Same here.</p>
<p>You have to go there in person and talk to the old lady at the gate, then it takes a week at most.</p></section><div><p>Canal gardens, Lock Road 1, open on Thursdays from four to six, but not in the holidays.</p></div></body>""",
    """<body><div class="top"><a href=1>Paper</a> <a href=2>Town</a></div><div id="main"><h1 data-main>A wall falls down</h1><p data-main>The wall behind the brewery fell into the stream last night, and with it the ivy that had held it for eighty years.</p>
<p data-main>Nobody was hurt.</p><p data-main>The brewery says that it had asked for leave to mend the wall in spring and has not heard from the town since then.</p></div>
<div class="voices"><h3>Your voices</h3><p>I walked past there an hour earlier with the dog and heard a sound like a big clock, now I know what it was.</p><p>The ivy was the best thing about it.</p><p>Who pays for this?</p></div>
<div class="bottom"><p>Town paper, Quay Street 4, printed on paper from our own mill. All texts belong to those who wrote them.</p></div></body>""",
    """<body><ul><li><a href=1>Eat</a></li><li><a href=2>Drink</a></li></ul><div class="menu-of-the-week"><h1 data-main>Menu of the week</h1><p data-main>On Monday there is soup of green peas with bread from the oven next door, as much as you like of both.</p>
<p data-main>On Tuesday we are closed.</p><p data-main>On Wednesday and on Thursday the cook makes dumplings after her grandmother, with plums or with onions and bacon.</p></div>
<div class="lower"><p>The canteen is in the yard of the old post office, ring twice and wait until somebody opens the gate for you.</p></div></body>""",
    """<body><article><h1 data-main>Two clocks</h1><p data-main>The church clock and the clock of the town hall have not agreed since the summer of the flood.</p><div class="alert-story"><p data-main>On that day the alarm was rung by hand, and the man who rang it leaned his ladder against the works.</p></div>
<p data-main>He never said so.</p><div class="popular-view"><p data-main>Most people in the town go by the church, which is four minutes late and has the finer sound.</p></div></article>
<div class="say"><h4>Six answers</h4><p>My father set the town hall by the radio every morning and it was right until he stopped working there.</p><p>Four minutes are nothing.</p><p>Ask the station, they have a third one and it stands.</p></div>
<div class="end"><p>Sent out by the friends of the old town, who meet on the first Friday of each month at the well.</p></div></body>""",
    """<body><div class="head"><p>The post of the valley, every day but Sunday, since the year of the great snow</p></div><div class="story"><h2 data-main>The last bus</h2><p data-main>From autumn on the last bus up the valley leaves at seven and no longer at nine in the evening.</p>
<p data-main>The driver, who has gone up at nine for twenty years, says that he will walk then.</p></div><div class="more"><p><a href=1>Snow on the pass</a></p><p><a href=2>New school, old teachers</a></p></div>
<div class="words"><p>And how do we get home from the cinema, it ends at half past eight?</p><p>By bicycle, as we did when we were young and there was no bus at all.</p></div></body>""",
    """<body><div><a href=1>Walks</a></div><article><h1 data-main>Along the dyke in nine hours</h1><p data-main>The walk begins at the lock, where the bus from the station stops every hour, and ends at the mill with the red wings.</p>
<p data-main>Take bread and water with you, as there is no inn on the way since the one at the ferry has closed for good.</p><div class="search-tip"><p data-main>The first sign is hidden by a willow, so look for the white stone beside it.</p></div>
<p data-main>Behind the second gate the path leaves the dyke and follows a ditch for a mile, which is wet in spring.</p><div class="promo"><p>Boots that never leak, now in three colours, at the shop by the lock.</p></div>
<p data-main>Sheep stand on the path and do not mind.</p><p data-main>From the pumping station you see both churches at once, the one with the flat roof and the one that leans to the west.</p>
<div class="form-note"><p data-main>Those who come with a school have to sign a sheet at the station.</p></div><p data-main>After six hours you reach the ferry, which runs when somebody rings the bell, and costs as much as a loaf of bread.</p>
<div class="related-box"><p>Four more walks by the water for days on which it does not rain.</p></div><p data-main>On the other side the path is made of bricks.</p>
<p data-main>The last hour goes through orchards, where you may eat what lies on the ground but not what hangs on the trees.</p><section class="legal-history"><p data-main>By an old law the dyke belongs to all who live behind it, each to a yard of its length.</p></section>
<p data-main>At the mill they sell flour on Saturdays, and a bed for the night can be had from the miller's sister.</p><div class="newsletter"><p>A new walk in your letter box on the first of each month.</p></div>
<p data-main>The bus back leaves at seven.</p></article><div class="replies"><p>The ferry man is my cousin and he says that the bell has been stolen, so shout.</p><p>Shout loud.</p></div></body>""",
    """<body><div><a href=1>Index</a></div><div><p data-main>This note is about the numbers on the backs of old chairs, which most people take for prices but which are nothing of that kind.</p>
<p data-main>They stand for the tree.</p><p data-main>Each tree of the forest had a number, and the chairs that were made of one tree got that number, so that they could be put together again.</p></div>
<div class="comments"><p>Mine has a number with a cross behind it, does anybody know whether that means that the tree was sick?</p><p>It means second choice.</p></div><div>Written for the chair museum</div></body>""",
    """<body><nav><a href=1>Home</a></nav><article><h1 data-main>The well is dry</h1><p data-main>For the first time since the war the well on the market is dry, and the geese stand around it and look in.</p>
<p data-main>The town sends a pump.</p><section class="comment-list"><h3>Comments</h3><p>It was dry in the year in which I married too, and nobody remembers that but me and my wife.</p><p>Poor geese.</p>
<p>If they had not dug the garage under the bank there would be water in it, we all said so at the time and were laughed at.</p><p>Quite so.</p><p>My grandfather fell into it twice.</p><p>Let the geese have the pond of the mayor, he is away until the end of the month anyway.</p></section></article><footer>Imprint</footer></body>""",
    """<body><article><h1 data-main>Night trains</h1><p data-main>The night train to the sea runs again from May, with four beds in each room and a carriage for bicycles.</p><p data-main>Dogs sleep on the floor.</p>
<p data-main>It leaves at ten in the evening and stops nowhere until it is light, so that nobody is woken by doors.</p><p data-main>Tickets are sold at the counter only, for reasons which the railway keeps to itself, from the first of April.</p>
<div class="opinions"><p>I took it as a child and never slept a minute.</p><p>Bring your own pillow.</p></div></article><div>Made in the station</div></body>""",
    """<body><article><h1 data-main>Ice on the lake</h1><p data-main>The lake is frozen, but the ice by the reeds holds nobody.</p><p data-main>Skates can be hired at the boat house from nine o'clock until it gets dark.</p><p data-main>Soup too.</p></article><footer>x</footer></body>""",
    """<body><nav><a href=1>Home</a></nav><article><h1 data-main>The long ladder</h1><p data-main>A ladder of forty rungs has been made for the chestnut in the school yard, which nobody could prune before.</p><p data-main>It is kept behind the gym.</p>
<div class="comments"><p>My brother made every third rung of it and none of them is straight.</p><p>Well done!</p><p>I would not climb it.</p></div></article></body>""",
    """<body><div><a href=1>Start</a></div><main><h1 data-main>Salt</h1><p data-main>Salt came up the river on flat boats and was weighed in the house with the green door.</p><p data-main>The scales are still there.</p><div id="responses"><p>The door was red when I was young.</p><p>It was never red.</p></div></main></body>""",
    """<body><nav><a href=1>All</a></nav><article><h1 data-main>Ink</h1><p data-main>Ink of oak galls turns black only when it has been on the paper for a day.</p><section class="discussion"><p>Ours stays brown, what are we doing wrong in this?</p><p>Too much water.</p></section></article></body>""",
    """<body><div>Home</div><div>Our team</div><div>Prices</div><div><p data-main>We repair bellows of every size, from those of a kitchen fire up to those of an organ with three manuals and a pedal.</p>
<p data-main>Leather is chosen by hand.</p><p data-main>A bellows that is used every day should be oiled once a year, and one that hangs on a wall should be opened now and then.</p></div><div>Bellows and sons</div><div>Tin Lane 7</div><div>Closed on Mondays</div></body>""",
    """<body><table><tr><td>Start</td><td>Map</td><td>About the author</td></tr></table><p data-main>The stones in the wood stand in a ring of nineteen, and the twentieth lies in the stream where the farmer rolled it.</p>
<p data-main>Nobody knows how old they are.</p><p data-main>If you stand in the middle at noon in June the shadow of the highest falls just on the gap, which may mean something or nothing.</p><div>Last change in May</div><div>Best seen with a large screen</div></body>""",
    """<body><div>Weather</div><div>Tide tables</div><div data-main>Boats that are longer than six metres may not lie at the inner wall from October on, as the bottom there rises with every storm.</div>
<div data-main>The buoys are taken in.</div><div data-main>Whoever wants to stay in the water all the same has to tell the keeper and leave the key of the boat with him.</div><div>Harbour keeper</div><div>Ring the bell twice</div></body>""",
    """<html><body><article><h1 data-main>A short note</h1><p data-main>The ferry to the lower village starts again on the second of March and takes carts.</p></article></body></html>""",
    """<body><h1 data-main>Owls</h1><p data-main>Owls sleep in the tower by day and hunt in the fields at night.</p><p data-main>They have been there longer than the tower.</p></body>""",
    """<body><article><p data-main>Flour is sold by weight and not by the bag, as bags were never equal and many a quarrel came of it.</p><p data-main>The weights hang by the door of the mill and may be used by all.</p></article></body>""",
    """<body><main><h2 data-main>Kites</h2><p data-main>A kite of paper flies in less wind than one of cloth and is soon gone.</p><ul><li data-main>Paper</li><li data-main>Glue</li><li data-main>Two sticks of the same length</li></ul></main></body>""",
    """<body><p data-main>Soon.</p></body>""",
    """<body><div data-main>Moved</div></body>""",
    """<body><p data-main>Under work</p></body>""",
    """<body><div class="wide"><p data-main>Seeds of the old kinds of beans can be had from the school garden for nothing but a promise to give some back.</p><p data-main>Sow them late.</p><div class="sidebar"><p>Come and help us.</p></div></div></body>""",
    """<body><div><p data-main>The tower is open to all who can climb two hundred steps and do not mind the bells when they strike.</p><div class="widget"><p>Opening hours of the tower and of the museum below it.</p></div></div></body>""",
    """<body><p data-main>Snails are counted in the vineyard each morning before the sun reaches the wall.</p><p data-main>Last year there were nine.</p><div class="cookie-banner"><p>This page keeps a cookie.</p></div></body>""",
    """<body><div><p data-main>A stove of tiles needs wood that has dried for two years, cut as long as a forearm.</p></div><div class="ads"><p>Tiles from the old works.</p></div></body>""",
    """<body><nav><a href=1>Home</a></nav><article><h1 data-main>Glass</h1><p data-main>The last glass blower of the valley works on Saturdays, when the furnace of the school is free.</p><section class="comments"><h3>Comments</h3><p>I still have a bowl that she made for my mother, and it rings like a bell when you touch it.</p><p>So has mine.</p></section></article><footer>Up</footer></body>""",
    """<body><nav><a href=1>Home</a></nav><article><h1 data-main>Moss</h1><p data-main>Moss on a roof does no harm as long as the slates beneath it are whole and the gutter is kept free.</p><p data-main>Leave it.</p><div class="feedback"><p>Ours took the slates with it in the first storm of the year.</p><p>Bad nails.</p></div></article><footer>Up</footer></body>""",
    """<body><nav><a href=1>Home</a></nav><article><h1 data-main>Chalk</h1><p data-main>Chalk was dug here until the pit filled with water, and children learn to swim in it now.</p><p data-main>It is cold.</p></article><footer>Up</footer></body>""",
    """<body><nav><a href=1>Home</a></nav><article><h1 data-main>Rope</h1><p data-main>A rope walk is as long as the longest rope that is made in it.</p><div class="reader-replies"><h3>Replies</h3><p>Ours was shorter and they made them round a corner.</p><p>No way.</p></div></article><footer>Up</footer></body>""",
)
