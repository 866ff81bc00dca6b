"""Pages written by hand, as sites have them: html, and the texts of their content blocks."""

PAGES = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Tides - Harbour Weekly</title><link rel=stylesheet href=a.css>
<body class=home><div id=top><a href=/>Harbour Weekly</a> <a href=/news>News</a> <a href=/sail>Sailing</a> <a href=/shop>Shop</a></div>
<div id=wrap><div class=post><h1>Why the spring tide was late this year</h1>
<p>The spring tide reached the outer wall on Tuesday, almost forty minutes after the table had promised it, and the boats that waited for it lay dry until noon.
<p>Harbour staff blame a long spell of easterly wind, which had held the water back for three days, and they expect the next one to arrive on time.
<p>Skippers are asked to check the notice board before they leave, since the gate will be opened by hand for the rest of the week.</div>
<div class=side><h3>Read next</h3><ul><li><a href=/1>Ten knots to know</a><li><a href=/2>Winter moorings</a><li><a href=/3>New ferry</a></ul></div></div>
<div id=foot>&copy; 2024 Harbour Weekly | <a href=/imprint>Imprint</a> | <a href=/privacy>Privacy</a></div>""",
        [
            "Why the spring tide was late this year",
            "The spring tide reached the outer wall on Tuesday, almost forty minutes after the table had promised it, and the boats that waited for it lay dry until noon.",
            "Harbour staff blame a long spell of easterly wind, which had held the water back for three days, and they expect the next one to arrive on time.",
            "Skippers are asked to check the notice board before they leave, since the gate will be opened by hand for the rest of the week.",
        ],
    ),
    (
        """<html><head><title>Bread</title></head><body><header><h2>Kitchen notes</h2></header><nav><ul><li><a href='#'>Soups</a></li><li><a href='#'>Breads</a></li><li><a href='#'>About</a></li></ul></nav>
<main><article><h1>A plain loaf for beginners</h1><p>Flour, water, salt and a little yeast are all you need, and most of the work is done while you wait for the dough to rise.</p>
<h2>What you need</h2><ul><li>Five hundred grams of flour, as fresh as you can get it.</li><li>Three hundred grams of lukewarm water, and a spoon of salt.</li></ul>
<p>Mix everything in a bowl until no dry flour is left, cover it with a cloth, and leave it alone for an hour in a warm place.</p><blockquote>My grandmother never weighed anything, and her bread was always better than mine.</blockquote></article></main>
<aside><p>Join our newsletter</p><form><input name=mail><button>Sign up</button></form></aside><footer>Copyright 2023 Kitchen notes. All rights reserved.</footer></body></html>""",
        [
            "A plain loaf for beginners",
            "Flour, water, salt and a little yeast are all you need, and most of the work is done while you wait for the dough to rise.",
            "What you need",
            "Five hundred grams of flour, as fresh as you can get it.",
            "Three hundred grams of lukewarm water, and a spoon of salt.",
            "Mix everything in a bowl until no dry flour is left, cover it with a cloth, and leave it alone for an hour in a warm place.",
            "My grandmother never weighed anything, and her bread was always better than mine.",
        ],
    ),
    (
        """<HTML><BODY><TABLE width=100%><TR><TD><A HREF=index.html>Home</A><TD><A HREF=list.html>List of members</A><TD><A HREF=mail.html>Mail</A></TABLE>
<H1>Report of the annual meeting</H1>
<P>The meeting was opened at eight by the chair, who thanked the members for coming in such weather and read the letter of the treasurer.
<P>It was decided, with two votes against, to repair the roof before the winter and to ask the council for a part of the cost.
<P>The next meeting will be held in April, when the accounts of the year will be laid before the members for approval.
<HR><TABLE><TR><TD><A HREF=1.html>1998</A><TD><A HREF=2.html>1999</A><TD><A HREF=3.html>2000</A></TABLE><ADDRESS>webmaster@club.example</ADDRESS></BODY></HTML>""",
        [
            "Report of the annual meeting",
            "The meeting was opened at eight by the chair, who thanked the members for coming in such weather and read the letter of the treasurer.",
            "It was decided, with two votes against, to repair the roof before the winter and to ask the council for a part of the cost.",
            "The next meeting will be held in April, when the accounts of the year will be laid before the members for approval.",
        ],
    ),
    (
        """<!DOCTYPE html><html><head><title>x</title><body><header><a href=/>Alpine Club</a><form><select name=lang><option>English<option>Deutsch<option>Italiano</select><button>Go</button></form></header>
<section class=content><h1>Closing of the north hut</h1><div class=meta>Posted by Eva on 3.11.2022</div><p>The hut below the north face stays closed until the new stairs are finished, which will take longer than was planned because of early snow.</p>
<p>Climbers can sleep in the small shelter near the spring, but they have to bring their own blankets, and there is no stove.</p></section>
<section class=comments><h3>2 comments</h3><div>Thanks for the news!</div><div>See you there</div></section><footer><ul><li><a href=/c>Contact</a><li><a href=/j>Jobs</a></ul></footer></body></html>""",
        [
            "Closing of the north hut",
            "The hut below the north face stays closed until the new stairs are finished, which will take longer than was planned because of early snow.",
            "Climbers can sleep in the small shelter near the spring, but they have to bring their own blankets, and there is no stove.",
        ],
    ),
]
