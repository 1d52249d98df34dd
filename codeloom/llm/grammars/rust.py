"""Rust 2021. Operators have no precedence here, as only validity matters.

'>+' and '>=+' are '>' and '>=' right after another '>'. Token trees of macros
and attributes are any tokens with balanced brackets.
"""

TOKENS = """
NAME LIFETIME CHAR STR NUM
as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while auto default macro_rules
+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= = == != > < >= <= >+ >=+ @ _ . .. ... ..= , ; : :: -> => # $ ? ~
""".split()

GRAMMAR = r"""
Crate: InnerAttr* Item*
InnerAttr: '#' '!' '[' Trees? ']'
Attr: '#' '[' Trees? ']'
Trees: Tree+
Tree: Any | '(' Trees? ')' | '[' Trees? ']' | '{' Trees? '}'
Any: %ANY%
Name: NAME | 'union' | 'auto' | 'default' | 'macro_rules'
Vis: 'pub' | 'pub' '(' ('crate' | 'self' | 'super') ')' | 'pub' '(' 'in' ModPath ')'
ModPath: '::'? Segment % '::'
Segment: Name | 'crate' | 'self' | 'super' | 'Self'
Item: Attr* Vis? ItemKind | Attr* MacroItem
MacroItem: ModPath '!' '{' Trees? '}' | ModPath '!' '(' Trees? ')' ';' | ModPath '!' '[' Trees? ']' ';' | 'macro_rules' '!' Name '{' Trees? '}' | 'macro_rules' '!' Name '(' Trees? ')' ';'
ItemKind: 'use' UseTree ';' | 'mod' Name ';' | 'unsafe'? 'mod' Name '{' InnerAttr* Item* '}' | Fn | Struct | 'enum' Name Generics? Where? '{' Variants? '}' | 'union' Name Generics? Where? '{' Fields? '}'
    | Trait | Impl | TypeItem | ConstItem | 'static' 'mut'? Name ':' Type ('=' Expr)? ';' | 'extern' 'crate' Name ';' | 'extern' 'crate' (Name | 'self') 'as' (Name | '_') ';' | 'unsafe'? 'extern' STR? '{' InnerAttr* Item* '}'
ConstItem: 'const' (Name | '_') ':' Type ('=' Expr)? ';'
TypeItem: 'type' Name Generics? (':' Bounds)? Where? ('=' Type)? Where? ';'
UseTree: UsePath | UsePath 'as' (Name | '_') | UsePath '::' '*' | '*' | '::' '*' | UsePath '::' '{' UseList? '}' | '{' UseList? '}' | '::' '{' UseList? '}'
UsePath: Segment | '::' Segment | UsePath '::' Segment
UseList: UseTree % ',' ','?
Fn: FnQual* 'fn' Name Generics? '(' FnParams? ')' Ret? Where? (Block | ';')
FnQual: 'const' | 'async' | 'unsafe' | 'default' | 'extern' | 'extern' STR
FnParams: FnParam % ',' ','?
FnParam: Attr* PatNoAlt ':' Type | Attr* SelfParam | Attr* PatNoAlt ':' '...' | '...'
SelfParam: 'mut'? 'self' (':' Type)? | '&' LIFETIME? 'mut'? 'self'
Ret: '->' Type
Struct: 'struct' Name Generics? Where? '{' Fields? '}' | 'struct' Name Generics? ';' | 'struct' Name Generics? '(' TupleFields? ')' Where? ';'
Fields: Field % ',' ','?
Field: Attr* Vis? Name ':' Type
TupleFields: TupleField % ',' ','?
TupleField: Attr* Vis? Type
Variants: Variant % ',' ','?
Variant: Attr* Vis? Name ('{' Fields? '}' | '(' TupleFields? ')')? ('=' Expr)?
Trait: 'unsafe'? 'auto'? 'trait' Name Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}'
Impl: 'default'? 'unsafe'? 'impl' Generics? 'const'? '!'? Type Where? '{' InnerAttr* Item* '}' | 'default'? 'unsafe'? 'impl' Generics? '!'? Type 'for' Type Where? '{' InnerAttr* Item* '}'
Generics: '<' '>' | '<' GenParam % ',' ','? Close
GenParam: Attr* LIFETIME (':' LifeBounds?)? | Attr* Name (':' Bounds?)? ('=' Type)? | Attr* 'const' Name ':' Type ('=' ConstArg)?
LifeBounds: LIFETIME % '+' '+'?
Close: '>' | '>+'
Where: 'where' | 'where' WherePred % ',' ','?
WherePred: LIFETIME ':' LifeBounds? | ForLives? Type ':' Bounds?
ForLives: 'for' '<' '>' | 'for' '<' GenParam % ',' ','? Close
Bounds: Bound % '+' '+'?
Bound: LIFETIME | '?'? ForLives? TypePath | '(' '?'? ForLives? TypePath ')'

Type: TypePath | '(' ')' | '(' Type ')' | '(' Type ',' ')' | '(' Type ',' Type % ',' ','? ')' | '!' | '_' | ('&' | '&&') LIFETIME? 'mut'? Type | '*' ('const' | 'mut') Type | '[' Type ']' | '[' Type ';' Expr ']'
    | ForLives? FnTypeQual* 'fn' '(' BareParams? ')' Ret? | 'impl' Bounds | 'dyn' Bounds | ForLives TypePath | TypePath '!' '(' Trees? ')' | TypePath '!' '[' Trees? ']' | TypePath '!' '{' Trees? '}'
FnTypeQual: 'unsafe' | 'extern' | 'extern' STR
BareParams: BareParam % ',' ','?
BareParam: Attr* Type | Attr* (Name | '_') ':' Type | '...'
TypePath: TypeSeg | '::' TypeSeg | TypePath '::' TypeSeg | QSelf '::' TypeSeg
TypeSeg: Segment | Segment GenArgs | Segment '::' GenArgs | Segment '(' TypeList? ')' Ret?
TypeList: Type % ',' ','?
QSelf: '<' Type ('as' TypePath)? Close
GenArgs: '<' '>' | '<' GenArg % ',' ','? Close
GenArg: LIFETIME | Type | Name GenArgs? '=' Type | Name GenArgs? ':' Bounds | ConstArg
ConstArg: Literal | '-' Literal | Block | Name
Literal: STR+ | CHAR | NUM | 'true' | 'false'

Pat: '|'? PatNoAlt % '|'
PatNoAlt: '_' | '..' | PatLit | PatLit ('..=' | '..' | '...') PatEnd | PatLit '..' | ('..=' | '..') PatEnd | 'ref'? 'mut'? Name ('@' PatNoAlt)? | PatPath | PatPath ('..=' | '..' | '...') PatEnd | PatPath '..'
    | ('&' | '&&') 'mut'? PatNoAlt | '(' ')' | '(' Pats ')' | '[' ']' | '[' Pats ']' | PatPath '(' ')' | PatPath '(' Pats ')' | Name '(' ')' | Name '(' Pats ')' | PatPath '{' PatFields? '}' | Name '{' PatFields? '}' | ExprPath '!' '(' Trees? ')' | ExprPath '!' '[' Trees? ']' | 'const' Block
Pats: Pat % ',' ','?
PatLit: Literal | '-' NUM
PatEnd: PatLit | ExprPath
PatPath: PathMore
PatFields: PatField % ',' ','?
PatField: Attr* 'ref'? 'mut'? Name | Attr* (Name | NUM) ':' Pat | '..'

Block: '{' InnerAttr* Stmts '}' | '{' InnerAttr* Stmts Attr* Expr '}'
Stmts: | Stmts Stmt
Stmt: ';' | Item | Attr* Let | Attr* Expr ';' | Attr* BlockLike
Let: 'let' Pat (':' Type)? ';' | 'let' Pat (':' Type)? '=' Expr ('else' Block)? ';'
Expr: Bin | Low
Low: Closure | 'return' | 'return' Expr | 'break' LIFETIME? | 'break' LIFETIME? Expr | 'continue' LIFETIME? | Bin BinOp Low | UnOp Low
Closure: ('static' | 'async' | 'move' | ForLives)* '|' ClosureParams? '|' ClosureBody | ('static' | 'async' | 'move' | ForLives)* '||' ClosureBody
ClosureBody: Expr | '->' Type Block
ClosureParams: ClosureParam % ',' ','?
ClosureParam: Attr* PatNoAlt (':' Type)?
Bin: Un | Bin BinOp Un | Bin 'as' Type | Bin ('..' | '..=') Un | Bin '..' | '..' | ('..' | '..=') Un | 'let' Pat '=' Un
BinOp: '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '<<' | '>' '>+' | '==' | '!=' | '>' | '<' | '>=' | '<=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>=+'
Un: Post | UnOp Un
UnOp: '-' | '!' | '*' | ('&' | '&&') 'mut'? | ('&' | '&&') 'raw' ('const' | 'mut')
Post: Prim | Post '?' | Post '.' 'await' | Post '.' Name | Post '.' NUM | Post '.' (Name | 'self') '::' GenArgs '(' Exprs? ')' | Post '(' Exprs? ')' | Post '[' Expr ']'
Exprs: ArgExpr % ',' ','?
ArgExpr: Attr* Expr
Prim: Literal | ExprPath | ExprPath '{' StructFields? '}' | '(' ')' | '(' InnerAttr* Attr* Expr ')' | '(' Expr ',' ')' | '(' Expr ',' Exprs ')' | '[' ']' | '[' Exprs ']' | '[' Expr ';' Expr ']' | BlockLike | Macro | '_'
Macro: ExprPath '!' '(' Trees? ')' | ExprPath '!' '[' Trees? ']' | ExprPath '!' '{' Trees? '}'
BlockLike: Label? Block | 'unsafe' Block | 'async' 'move'? Block | 'const' Block | If | Match | Label? 'loop' Block | Label? 'while' Expr Block | Label? 'for' Pat 'in' Expr Block
Label: LIFETIME ':'
If: 'if' Expr Block | 'if' Expr Block 'else' Block | 'if' Expr Block 'else' If
Match: 'match' Expr '{' InnerAttr* Arms? '}'
Arms: Arm* LastArm
Arm: Attr* Pat Guard? '=>' Expr ',' | Attr* Pat Guard? '=>' BlockLike
LastArm: Attr* Pat Guard? '=>' Expr ','?
Guard: 'if' Expr
ExprPath: Segment | PathMore
PathMore: '::' Segment | ExprPath '::' Segment | ExprPath '::' GenArgs | QSelf '::' Segment
StructFields: StructField % ',' ','? | StructField % ',' ',' '..' Expr | '..' Expr | StructField % ',' ',' '..' | '..'
StructField: Attr* Name | Attr* (Name | NUM) ':' Expr
""".replace("%ANY%", " | ".join(t if t.isupper() and t.isalpha() else f"'{t}'" for t in TOKENS))
