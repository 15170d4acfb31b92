"""The small labelled table of text blocks that the extraction's decision tree is trained on.

One page a paragraph; one block a line: path of containers (tag.class), leaf (tag, or tag.class), words,
linked words, label (1 main text). "xN" repeats a line N times. Written by hand for this table.
"""

LABELLED = """
nav/ul li 1 1 0 x6
div.ad div 9 0 0
article h1 12 0 1
article p 80 0 1
article p 3 0 1
article p 45 2 1
article p 1 0 1
footer div 14 0 0

header div 3 3 0
nav/ul li 2 2 0 x4
main/article/header h1 7 0 1
main/article p 120 3 1
main/article h2 3 0 1
main/article/ul li 6 0 1 x3
main/article/blockquote p 30 0 1
main/article p 9 9 1
main/article/aside p 25 4 0
main/article/div.share div 5 5 0
aside h3 2 0 0
aside/ul li 5 5 0 x5
footer p 12 3 0
footer p 40 0 0

div.cookie-notice p 24 2 0
div.cookie-notice p 2 2 0
div.header div 2 2 0
div.menu/ul li 1 1 0 x8
div.content h1 9 0 1
div.content p 60 1 1
div.content p 5 0 1
div.content p 140 4 1
div.content/form p 8 0 0
div.content/form label 2 0 0
div.content/div.advert p 15 0 0
div.content p 22 0 1
div.sidebar h4 2 0 0
div.sidebar/ul li 6 6 0 x4
div.sidebar p 35 0 0
div.comments h3 2 0 0
div.comments/div p 40 0 0
div.comments/div p 12 0 0
div.footer p 16 2 0

div div 2 2 0
div/ul li 2 2 0 x5
div h1 8 0 1
div p 75 2 1
div p 14 0 1
div p 55 0 1
div p 31 1 1
div div 4 4 0
div div 7 0 0

table/tr td 1 1 0 x6
table/tr td 150 3 1
table/tr td 90 0 1
table/tr td 3 2 0
table/tr td 6 0 0

div.navbar/ul li 1 1 0 x5
section.post h2 6 0 1
section.post p 18 0 1
section.post p 66 5 1
section.post/figure figcaption 8 0 1
section.post/pre pre 20 0 1
section.post/div.related h3 2 0 0
section.post/div.related/ul li 7 7 0 x3
section#comments h3 2 0 0
section#comments/article p 50 0 0
section#comments/article p 6 0 0
footer div 5 1 0

div.banner p 30 0 0
div.newsletter/form p 12 0 0
main h1 5 0 1
main p 2 0 1
main p 10 0 1
main/table/tr td 3 0 1 x4
main p 95 1 1
div.promo p 60 1 0
div.popup p 33 0 0
div.legal p 80 2 0

body p 90 0 1
body p 64 1 1
body p 2 0 1
body p 40 0 1

body h1 6 0 1
body p 12 0 1

nav/ul li 3 3 0 x3
article p 1 0 1
article p 2 0 1
footer div 20 0 0
footer div 1 0 0

nav/ul li 1 1 0 x4
div.has-sidebar h1 8 0 1
div.has-sidebar p 85 1 1
div.has-sidebar p 12 0 1
div.has-sidebar p 60 0 1
div.has-sidebar p 110 2 1
div.has-sidebar/div.sidebar h4 2 0 0
div.has-sidebar/div.sidebar/ul li 5 5 0 x5
div.has-sidebar/div.sidebar p 28 0 0
footer div 9 2 0

div.navbar/ul li 2 2 0 x5
div.widget-wrap/div.content h2 7 0 1
div.widget-wrap/div.content p 70 0 1
div.widget-wrap/div.content p 4 0 1
div.widget-wrap/div.content p 44 1 1
div.widget-wrap/div.content p 9 0 1
div.widget-wrap/div.content p 130 3 1
div.widget-wrap/div.content/ul li 7 7 0 x4
div.widget-wrap/div.related h3 2 0 0
div.widget-wrap/div.related/ul li 6 6 0 x3
div.sidebar/div.content h4 2 0 0
div.sidebar/div.content p 26 1 0
div.sidebar/div.content p 5 5 0
div.copyright p 14 1 0

form/div div 2 2 0 x4
form/div h1 9 0 1
form/div p 66 1 1
form/div p 18 0 1
form/div p 90 0 1
form/div p 7 0 1
form/div p 52 2 1
form/div/ul li 4 4 0 x5
form label 2 0 0
form div 6 6 0

form/div.menu/ul li 2 2 0 x5
form/div.content h1 6 0 1
form/div.content p 58 0 1
form/div.content p 16 1 1
form/div.content p 100 2 1
form/div.content p 5 0 1
form/div.footer p 12 2 0

div.wrap-header-fixed/div.post h1 7 0 1
div.wrap-header-fixed/div.post p 35 0 1
div.wrap-header-fixed/div.post p 15 1 1
div.wrap-header-fixed/div.post p 48 0 1
div.social div 4 4 0

form label 2 0 0 x3
form p 11 0 0
form div 3 0 0
form p 18 2 0

div.entry-meta div 4 1 1
div.no-sidebar p 75 0 1
div.no-sidebar p 20 1 1
div.no-sidebar p 64 0 1
div.no-sidebar p 98 1 1

nav/ul li 2 2 0 x4
article h1.page-header 7 0 1
article p 50 1 1
article/div.ad p 18 0 0
article p 44 0 1
article p.advert 20 0 0
article p 8 8 1
article p 62 2 1
article p.promo 55 3 0
article/ul li 8 8 0 x6
article p.sponsored 9 0 0
article p 30 0 1
article/ul li 9 1 1 x3
article/div.newsletter p 32 0 0
article/form p 14 0 0
article/div.related/div.content p 20 4 0
article/div.related/div.content p 12 12 0
article div 6 6 0
article div 5 5 0
article div 7 7 0

main h1 6 0 1
main p 40 1 1
main/ul li 7 7 0 x4
main p 72 0 1
main/table/tr td 3 3 0 x5
main p 38 1 1
main/ul li 3 0 1 x4
main/form p 22 0 0
main p.notice 40 0 0
main/div.cookie p 60 1 0

article/div.content-with-sidebar h1 6 0 1
article/div.content-with-sidebar p 60 0 1
article/div.content-with-sidebar p 9 0 1
article/div.content-with-sidebar p 80 2 1
article/div.content-with-sidebar p.advert 24 0 0
article/div.content-with-sidebar/ul li 6 6 0 x4

div.comments p 60 0 0
div.comments p 45 0 0
div.comments p 90 1 0
div.comments/form p 10 0 0

nav/ul li 2 2 0 x3
nav h1 6 0 1
nav p 75 0 1
nav p 15 0 1
nav p 90 2 1
nav/footer div 8 2 0

form p 60 0 1
form p 27 1 1
form p 75 0 1
form p 90 0 1

body/form p 300 2 1

form/div.menu/ul li 1 1 0 x4
form/table/tr td 40 0 1
form/table/tr td 12 0 1
form/table/tr td 120 3 1
form label 1 0 0
form label 3 0 0

body/ul li 3 3 0 x6
div.widget-wrap/div.content p 60 0 1
div.widget-wrap/div.content p 27 0 1
div.widget-wrap/div.content p 88 1 1

ul li 2 2 0 x5
div.page-with-sidebar p 250 2 1

div/ul li 4 4 0 x5
form p 80 0 1
form p 35 0 1
form/ul li 3 3 0 x5

article h1 5 0 1
article p 70 1 1
article p 90 0 1
article p.ad 12 0 0
article p 60 0 1
form label 2 0 0
form p 25 0 0
div.sidebar p 55 0 0
div.sidebar/ul li 4 4 0 x4
div.disclaimer p 110 1 0

article p 6 0 1
div.main-with-sidebar p 70 0 1
div.main-with-sidebar p 110 1 1
div.main-with-sidebar p 45 0 1
div.newsletter p 30 0 0

div h1 6 0 1
div p 40 1 1
div p 55 0 1
div p 22 0 1
div.comments h3 2 0 0
div.comments p 70 0 0
div.comments p 90 0 0
div.comments p 120 1 0
div.comments p 60 0 0
div.footer p 60 3 0

div h1 5 0 1
div p 30 0 1
div p 45 1 1
div.legal p 50 0 0
div.disclaimer p 60 1 0
footer p 50 2 0

main h1 3 0 1
main p 60 14 1
main p 90 30 1
main h2 2 0 1
main p 35 12 1
main/ul li 14 5 1
main/ul li 11 4 1
main/ul li 9 3 1
main p 25 9 1
main h2 2 0 1
main/ul li 4 4 0 x6
nav/ul li 2 2 0 x4

section.post h2 5 0 1
section.post p 20 5 1
section.post p 16 3 1
section.post/div div 3 3 0 x4
div.footer p 20 8 0

div/ul li 2 2 0 x4
div h1 5 0 1
div p 50 10 1
div p 30 8 1
div p 70 12 1
div p 6 2 0
div/ul li 4 4 0 x4

article p 45 1 1
article p 12 4 1
article p 30 7 1

nav/ul li 2 2 0 x4
div.has-sidebar h1 4 0 1
div.has-sidebar h2 2 0 1
div.has-sidebar p 60 0 1
div.has-sidebar p 30 0 1
div.has-sidebar h2 3 0 1
div.has-sidebar p 8 0 1
div.has-sidebar p 70 2 1
div.has-sidebar/div.sidebar h4 2 0 0
div.has-sidebar/div.sidebar p 40 0 0
div.has-sidebar/div.sidebar p 30 0 0
div.comments h3 2 0 0
div.comments p 90 0 0
div.comments p 150 0 0
div.footer p 60 3 0

nav/ul li 2 2 0 x4
form h1 3 0 1
form p 60 0 1
form h2 2 0 1
form p 44 1 1
form/div.sidebar p 50 0 0
form/div.comments p 90 0 0
form/div.legal p 40 1 0
footer p 20 0 0

nav/ul li 1 1 0 x4
article h1 7 0 1
article p 240 0 1
article p 310 2 1
article p 180 0 1
article p 900 9 1

div.sidebar-layout h1 6 0 1
div.sidebar-layout p 260 0 1
div.sidebar-layout p 200 1 1
div.sidebar-layout p 330 0 1
div.copyright p 9 0 0

nav/ul li 1 1 0 x6
div.ad div 8 0 0
article h1 1 0 1
article p 1 0 1
article p 2 0 1
article p 1 0 1
article p 2 0 1
footer div 9 0 0

nav/ul li 1 1 0 x4
article h1 2 0 1
article p 1 0 1
div.ad div 8 0 0
footer div 9 0 0

article h1 3 0 1
article p 2 0 1
article p 3 0 1
article p 200 0 1
article p 1 0 1
article p 1 0 1
article p 14 0 1
article/ul li 2 0 1 x4
article p 2 0 1
footer div 3 0 0

nav/ul li 1 1 0 x5
article p 1 0 1
div.ad div 8 0 0
footer div 9 0 0

main h1 1 0 1
main p 2 0 1
main p 1 0 1
main h2 1 0 1
main p 1 0 1
main p 2 0 1
div.ad p 9 0 0

div.content h1 1 0 1
div.content p 2 0 1
div.content p 1 0 1
div.content p 2 0 1
div.content p 6 0 1
div.footer p 4 0 0

nav/ul li 1 1 0 x3
header p 3 0 0
article h1 1 0 1
article p 60 0 1
article p 1 0 1
article p 90 6 1
article p 2 0 1
article p 2 0 1
footer p 30 0 0

div h1 1 0 1
div p 30 0 1
div p 2 0 1
div p 1 0 1
div p 44 1 1
div p 2 0 1
div div 2 2 0
div div 3 3 0

div div 1 1 0 x4
div div 3 0 0
div h1 4 0 1
div p 12 0 1
div p 3 0 1
div p 25 2 1
div p 9 0 1
div div 3 3 0
div div 2 2 0
div div 5 1 0

table/tr td 1 1 0 x4
table/tr td 60 1 1
table/tr td 12 0 1
table/tr td 45 2 1
table/tr td 2 2 0 x4
table/tr td 4 1 0

div p 2 2 0 x3
div p 5 5 0
div p 80 2 1
div p 15 1 1
div p 50 0 1
div p 4 4 0
div p 6 6 0
div p 3 3 0

body div 3 3 0
body div 2 2 0
body div 70 3 1
body div 18 0 1
body div 52 1 1
body div 40 0 1
body div 3 3 0
body div 6 4 0

div p 4 3 0
div p 3 3 0
div p 33 2 1
div p 48 0 1
div p 11 0 1
div p 62 4 1
div p 5 4 0
div p 9 7 0
div p 6 5 0

article p 1 0 1
article p 1 0 1
article p 40 0 1
article p 12 0 1
article/div.share p 3 0 0
article/div.share p 4 4 0
article/aside p 12 0 0
article p 1 0 1
article p 9 9 0

header div 4 0 0
main/article h1 2 0 1
main/article p 1 0 1
main/article p 2 0 1
main/article h2 1 0 1
main/article p 5 0 1
aside p 2 0 0
aside p 20 0 0
footer p 1 0 0

section.post h1 1 0 1
section.post p 2 0 1
section.post p 1 0 1
section.post p 3 0 1
div.sidebar p 2 0 0
div.comments p 2 0 0
div.comments p 1 0 0

nav/ul li 2 2 0 x3
article h1 4 0 1
article p 50 0 1
article p 20 0 1
article p 3 0 1

article h1 1 0 1
article p 1 0 1

main p 18 0 1
main p 22 1 1
main p 7 0 1

div h1 3 0 1
div p 40 0 1
div p 17 0 1
div p 21 1 1

article p 20 0 1
article p 2 0 1

div.content p 60 2 1
div.content p 19 0 1
div.content p 5 0 1

body p 70 0 1
body p 23 0 1
body p 9 0 1

main/article h1 4 0 1
main/article p 10 0 1
div.cookie p 20 0 0

article p 80 1 1
article p 16 0 1
div.ad p 16 0 0

nav/ul li 1 1 0 x2
article h1 3 0 1
article p 50 0 1
article p 30 0 1
div.comments p 2 0 0
footer p 1 0 0

nav/ul li 2 2 0 x3
main h1 3 0 1
main p 4 0 1
main p 35 0 1
footer p 3 0 0

div/ul li 1 1 0 x4
div h1 3 0 1
div p 33 0 1
div p 28 0 1

nav/ul li 1 1 0 x5
div.content h1 3 0 1
div.content p 3 0 1
div.content p 48 1 1
div.footer p 6 0 0

nav/ul li 1 1 0 x3
article p 3 0 1
article p 4 0 1
article p 26 0 1

nav/ul li 1 1 0 x5
div.ad div 14 0 0
article h1 2 0 1
article p 2 0 1
footer div 3 0 0

nav/ul li 2 2 0 x3
div.advert div 25 0 0
article h1 1 0 1
article p 3 0 1

div.promo div 40 0 0
main h1 3 0 1
main p 6 0 1
footer p 5 0 0

div.ad p 18 0 0
article p 4 0 1
article p 2 0 1
"""
