"""Python 3. Operators have no precedence here, as only validity matters."""

GRAMMAR = r"""
File: Stmt*
Stmt: Simple | Compound
Simple: Small % ';' ';'? NEWLINE
Name: NAME | 'match' | 'case' | 'type'
Small: Exprs | Chain | Exprs AugOp Rhs | Target ':' Expr | Target ':' Expr '=' Rhs | Yield | 'pass' | 'break' | 'continue' | 'return' Exprs? | 'raise' | 'raise' Expr | 'raise' Expr 'from' Expr
    | 'global' Name % ',' | 'nonlocal' Name % ',' | 'del' Exprs | 'assert' Expr | 'assert' Expr ',' Expr | Import | 'type' Name TypeParams? '=' Expr
Chain: Exprs '=' Rhs | Exprs '=' Chain
Target: Primary
Rhs: Exprs | Yield
Yield: 'yield' Exprs? | 'yield' 'from' Expr
AugOp: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
Import: 'import' DottedAs % ',' | 'from' Dots? Dotted 'import' What | 'from' Dots 'import' What
Dots: ('.' | '...')+
Dotted: Name % '.'
DottedAs: Dotted | Dotted 'as' Name
What: '*' | NameAs % ',' | '(' NameAs % ',' ','? ')'
NameAs: Name | Name 'as' Name

Compound: If | While | For | Try | With | Def | Class | Decorators Def | Decorators Class | 'async' Def | Decorators 'async' Def | 'async' For | 'async' With | Match
Decorators: ('@' Named NEWLINE)+
Block: Simple | NEWLINE INDENT Stmt+ DEDENT
If: 'if' Named ':' Block Elif* Else?
Elif: 'elif' Named ':' Block
Else: 'else' ':' Block
While: 'while' Named ':' Block Else?
For: 'for' Targets 'in' Exprs ':' Block Else?
Targets: ForTarget % ',' ','?
ForTarget: BinNoIn | '*' BinNoIn
BinNoIn: Primary
Try: 'try' ':' Block Except+ Else? Finally? | 'try' ':' Block Finally
Except: 'except' ':' Block | 'except' '*'? Expr ':' Block | 'except' '*'? Expr 'as' Name ':' Block
Finally: 'finally' ':' Block
With: 'with' WithItem % ',' ':' Block | 'with' '(' WithItem % ',' ','? ')' ':' Block
WithItem: Expr | Expr 'as' ForTarget
Def: 'def' Name TypeParams? '(' Params? ')' ':' Block | 'def' Name TypeParams? '(' Params? ')' '->' Expr ':' Block
TypeParams: '[' TypeParam % ',' ','? ']'
TypeParam: Name | Name ':' Expr | Name '=' Expr | '*' Name | '**' Name
Params: Param % ',' ','?
Param: Name | Name ':' Expr | Name '=' Expr | Name ':' Expr '=' Expr | '*' | '*' Name | '*' Name ':' StarExpr | '**' Name | '**' Name ':' Expr | '/'
Class: 'class' Name TypeParams? ':' Block | 'class' Name TypeParams? '(' Args? ')' ':' Block
Match: 'match' Exprs ':' NEWLINE INDENT Case+ DEDENT
Case: 'case' Pattern % ',' ','? ':' Block | 'case' Pattern % ',' ','? 'if' Named ':' Block
Pattern: PatPrim % '|' | PatPrim % '|' 'as' Name | '*' Name
PatPrim: Dotted | PatNum | STR+ | 'None' | 'True' | 'False' | '(' ')' | '(' Pattern % ',' ','? ')' | '[' ']' | '[' Pattern % ',' ','? ']' | '{' '}' | '{' PatKey % ',' ','? '}' | Dotted '(' ')' | Dotted '(' PatArg % ',' ','? ')'
PatNum: NUM | '-' NUM | NUM '+' NUM | NUM '-' NUM | '-' NUM '+' NUM | '-' NUM '-' NUM
PatKey: PatPrim ':' Pattern | '**' Name
PatArg: Pattern | Name '=' Pattern

Exprs: StarExpr % ',' ','?
StarExpr: Expr | '*' Bin
Named: Expr | Name ':=' Expr
Expr: Bin | Bin 'if' Bin 'else' Expr | Lambda
Lambda: 'lambda' LamParams? ':' Expr
LamParams: LamParam % ',' ','?
LamParam: Name | Name '=' Expr | '*' | '*' Name | '**' Name | '/'
Bin: Un | Bin BinOp Un
BinOp: 'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
Un: Primary | ('not' | '-' | '+' | '~' | 'await') Un
Primary: Atom | Primary '.' Name | Primary '(' Args? ')' | Primary '[' Sub % ',' ','? ']'
Args: Arg % ',' ','?
Arg: Named | Named Comp | Name '=' Expr | '*' Expr | '**' Expr
Sub: Named | '*' Bin | Slice
Slice: Expr? ':' Expr? | Expr? ':' Expr? ':' Expr?
Comp: CompFor+
CompFor: 'async'? 'for' Targets 'in' Bin CompIf*
    | 'async'? 'for' Targets 'in' Lambda CompIf*
CompIf: 'if' Cond
Cond: Bin | Name ':=' Bin
Atom: Name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' Yield ')' | '(' Item % ',' ','? ')' | '(' Named Comp ')' | '[' ']' | '[' Item % ',' ','? ']' | '[' Named Comp ']'
    | '{' '}' | '{' Item % ',' ','? '}' | '{' Named Comp '}' | '{' Pair % ',' ','? '}' | '{' Expr ':' Expr Comp '}'
Item: Named | '*' Bin
Pair: Expr ':' Expr | '**' Bin
"""
